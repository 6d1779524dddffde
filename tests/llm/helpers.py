"""Small tables with every odd row: nulls, empty texts, ties, repeated rows, clashing columns."""

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as extra columns of the input.
CLASHES = "pos key h1 h2 version term start n a b id row chunk found score spans items keep gone n_words sequence_id"


def random_docs(seed: int, n: int = 60, longest: int = 80) -> list[tuple]:
    """Random word lists with exact and near copies, shared passages and odd rows."""
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(25)]
    texts: list = []
    for _ in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(1, longest))]
        if texts and r.random() < 0.35:
            w = (r.choice([t for t in texts if t]) or "x").split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(WORDS)
        if r.random() < 0.3:
            k = r.randrange(len(w) + 1)
            w = w[:k] + passage[r.randrange(5):] + w[k:]
        text = ""
        for x in w:
            text += x.upper() if r.random() < 0.02 else x
            text += r.choice([" "] * 8 + ["\n", "  "])
        texts.append(text)
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    return [*rows, (900, None), (901, ""), (902, " \n\t "), (903, None), rows[0], rows[0], (904, "é ü 漢字 " * 9), (905, texts[0])]


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES.split()])
    return df


def null_id(rows):
    """The rows plus two without an id."""
    return [*rows, (None, rows[0][1]), (None, None)]
