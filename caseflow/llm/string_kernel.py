"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel. Two words are compared by the letter triples they share in order, gaps
allowed: a triple spanning ``s`` letters weighs ``DECAY ** s``, up to ``SPAN`` letters.
Inserted or dropped letters only lower the weight. Words carry a mark at both
ends, so beginnings count; the product is divided by a function of the two
lengths. What is not a letter is taken out of a word first, and words of one
letter in a row are joined, so ``i.d-i o t`` is one word.

Learning. Sentences of clean texts hold clean words only; each sentence of a
toxic text that is marked holds at least one toxic word (a multiple-instance
SVM). Seeds are words of toxic texts alone that cover these texts greedily.
Landmarks are seeds and the clean words nearest to the decision border. A
squared-hinge SVM is fitted on the landmark features ``K(w, Z) K(Z, Z)^-1/2``; hard
clean words and a witness for each toxic text are added and it is fitted again.

Scoring. A kernel expansion over landmarks is a weight for each triple, so the
decision values of all words of a batch come from one table in a few vector
operations. A sentence scores its highest word, a text its highest sentence.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import hash_sample, stage
from caseflow.llm.hashing import _joined, by_bytes

SPAN, DECAY = 6, 0.6
TOXIC, CLEAN = 1000, 2500   # texts learned from of each label, at most
SEEDS, LANDMARKS, NEGATIVES = 400, 240, 3000
VARIANTS = 4          # gapped forms of each frequent seed
ROUNDS = 4
COST = 10.0
_SYMBOLS = 64


def _symbol_table() -> np.ndarray:
    """Byte -> symbol: 0 a word's end, 1-26 letters, 27-63 bytes of other letters, 255 taken out."""
    t = np.full(256, 255, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[65:91] = t[97:123] = np.arange(1, 27)
    t[128:] = 27 + np.arange(128) % 37
    return t


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, the mark before each text plus the last one); words stand between zeros."""
    data, offsets = _joined(texts)
    s = _symbol_table()[data]
    keep = s != 255
    begins = np.concatenate(([0], np.cumsum(keep)))[offsets]
    s = s[keep]
    # the blank between two words of one letter goes, inside a text
    z = np.concatenate(([True, True], s == 0, [True, True]))
    lone = z[2:-2] & ~z[1:-3] & z[:-4] & ~z[3:-1] & z[4:]
    lone[begins[1:] - 1] = False
    begins = begins - np.concatenate(([0], np.cumsum(lone)))[begins]
    return np.concatenate(([0], s[~lone])).astype(np.int32), begins


def words_of(text: str) -> set[bytes]:
    """Distinct words of a text as strings of symbols."""
    return set(symbols(pa.array([text]))[0].astype(np.uint8).tobytes().split(b"\0")) - {b""}


def _stack(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int32)


_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _triples(s: np.ndarray):
    """(triple, weight or 0) of every symbol as the first, for each pair of distances."""
    ends = np.flatnonzero(s == 0)
    reach = np.append(ends, len(s))[np.searchsorted(ends, np.arange(len(s)), side="right")] - np.arange(len(s))
    x = np.concatenate((s, np.zeros(SPAN, np.int32)))
    n = len(s)
    for a, b in _STEPS:
        yield (s << 12) | (x[a:a + n] << 6) | x[b:b + n], np.where(reach >= b, np.float32(DECAY ** (b + 1)), np.float32(0))


def _norms(n: np.ndarray) -> np.ndarray:
    """Length function: root of the summed squared weights of a word of n symbols with both marks."""
    total = sum(np.maximum(0, n - b) * DECAY ** (2 * (b + 1)) for b in range(2, SPAN) for _ in range(1, b))
    return np.sqrt(np.maximum(total, 1e-12))


def word_values(s: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mark before each word, the word's value) under a table of triple weights."""
    value = np.zeros(len(s), np.float32)
    for t, w in _triples(s):
        value += table[t] * w
    zero = np.flatnonzero(s == 0)
    size = np.diff(np.append(zero, len(s)))
    at, size = zero[size > 1], size[size > 1]
    if not len(at):
        return at, np.zeros(0, np.float32)
    # a word's triples begin at its leading mark or a letter; a mark before no word begins none
    return at, np.add.reduceat(value, at) / _norms(size + 1).astype(np.float32)


def _features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each word's triples and their weights, divided by the length function."""
    out = []
    for word in words:
        s = _stack([word])
        rows = [(t[w > 0], w[w > 0]) for t, w in _triples(s)]
        t, i = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
        out.append((t, np.bincount(i, np.concatenate([x for _, x in rows]), len(t)) / _norms(np.array([len(s)]))[0]))
    return out


def _matrix(rows, columns: np.ndarray) -> np.ndarray:
    m = np.zeros((len(rows), len(columns)))
    for i, (t, v) in enumerate(rows):
        at = np.searchsorted(columns, t)
        ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == t)
        m[i, at[ok]] = v[ok]
    return m


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(keep + COST * a.T @ x[on], COST * a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


@dataclass(frozen=True)
class Model:
    table: np.ndarray     # weight of each triple
    bias: float
    slope: float          # of the logistic curve over a text's value
    shift: float
    empty: float          # score of a text without words
    landmarks: list[bytes]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by Newton steps with a small ridge."""
    a, w = np.stack((x, np.ones(len(x))), 1), np.zeros(2)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _apart(docs: list[tuple[set[bytes], bool]]) -> list[tuple[set[bytes], bool]]:
    """The texts without near copies: none shares a band of three min-hashes of its words with one before it."""
    out, seen = [], set()
    for words, y in docs:
        h = np.array([zlib.crc32(w) for w in words], np.uint64)
        bands = {(k, *sorted((h * np.uint64(m) & np.uint64(0xFFFFFFFF)).tolist())[:3])
                 for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))} if len(h) > 20 else set()
        if not bands & seen:
            out.append((words, y))
        seen |= bands
    return out


def fit(texts: list[str], toxic: list[bool], share: float | None = None) -> Model | None:
    """Model of labelled texts; equal texts count once. None without both labels.

    ``share`` = share of toxic texts where scores are used (default: as given)."""
    docs = _apart([(words_of(t), y) for t, y in dict(zip(texts, toxic, strict=True)).items()])
    bad = [w for w, y in docs if y and w]
    clean = set().union(*(w for w, y in docs if not y))
    if not bad or not clean:
        return None
    held: dict[bytes, list[int]] = {}
    for i, words in enumerate(bad):
        for w in words - clean:
            held.setdefault(w, []).append(i)
    # words of several toxic texts and of no clean one: the frequent ones, and others that cover texts without any
    often = max(3, len(bad) // 50)
    seeds = sorted((w for w, i in held.items() if len(i) >= often), key=lambda w: (-len(held[w]), w))
    left = set(range(len(bad))).difference(*(held[w] for w in seeds))
    common = {w: i for w, i in held.items() if 1 < len(i) < often}
    while left and common and len(seeds) < SEEDS:
        best = max(common, key=lambda w: (len(left.intersection(common[w])), w))
        if len(left.intersection(common[best])) < 2:
            break
        seeds.append(best)
        left.difference_update(common.pop(best))
    seeds = seeds[:SEEDS] or sorted(held, key=lambda w: (-len(held[w]), w))[:SEEDS]
    if not seeds:
        return None

    pool, feats, rng = sorted(clean), {}, np.random.default_rng(8)
    # seeds with one letter inserted are toxic too
    at = [(w, int(rng.integers(1, len(w))), int(rng.integers(1, 27))) for w in seeds[:LANDMARKS // 4] if len(w) > 3 for _ in range(VARIANTS)]
    gapped = [v for v in (w[:i] + bytes([c]) + w[i:] for w, i, c in at) if v not in clean]
    negative = [pool[i] for i in rng.choice(len(pool), min(len(pool), NEGATIVES), replace=False)]
    positive = [*seeds, *gapped]

    def rows(words):
        new = [w for w in words if w not in feats]
        feats.update(zip(new, _features(new), strict=True))
        return [feats[w] for w in words]

    for step in range(ROUNDS):
        marks = positive[:LANDMARKS // 2] + negative[-(LANDMARKS // 2):]  # the hardest clean words stand last
        z = rows(marks)
        columns = np.unique(np.concatenate([t for t, _ in z]))
        zm = _matrix(z, columns)
        value, vector = np.linalg.eigh(zm @ zm.T)
        root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        x = np.vstack([_matrix(rows(positive), columns), _matrix(rows(negative), columns)]) @ zm.T @ root
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w = _svm(x, y, np.where(y > 0, len(negative) / len(positive), 1.0))
        table = np.zeros(_SYMBOLS ** 3, np.float32)
        table[columns] = zm.T @ (root @ w[:-1])
        if step == ROUNDS - 1:
            break
        f = word_values(_stack(pool), table)[1]
        hard = [pool[i] for i in np.argsort(-f, kind="stable")[:NEGATIVES // 2][::-1]]
        new = set(hard)
        negative = [v for v in negative if v not in new][-NEGATIVES:] + hard
        witness = [words[int(word_values(_stack(words), table)[1].argmax())] for words in map(sorted, bad)]
        counted = sorted({v for v in witness if v not in clean and len(held[v]) > 1}, key=lambda v: (-len(held[v]), v))
        positive = list(dict.fromkeys([*seeds, *counted, *gapped]))
    bias = float(w[-1])
    best = np.array([word_values(_stack(sorted(d)), table)[1].max() + bias if d else -5.0 for d, _ in docs])
    y = np.array([float(v) for _, v in docs])
    share = y.mean() if share is None else share
    slope, shift = _logistic(best, y, np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())))
    return Model(table, bias, slope, shift, 1 / (1 + float(np.exp(min(30.0, 5 * slope - shift)))), marks)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """Model of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, from at most ``toxic`` and
    ``clean`` whole texts of the two labels, chosen by hash.

    Rows with a null doc_id, text or label are left out; a doc_id with both labels
    counts as toxic. None without both labels. The sample is chosen on ids alone.
    """
    d = docs.where("doc_id is not null and text is not null")
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    y = stage(y.join(d.select("doc_id"), "doc_id", "left_semi"), "labels")  # no label of another document is learned from
    share = y.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    few = hash_sample(y, "toxic", F.when(F.col("toxic"), toxic).otherwise(clean))
    few = F.broadcast(few)  # toxic + clean rows at most
    rows = d.select("doc_id", "text").join(few, "doc_id").orderBy("doc_id", "text").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def _score(model: Model | None, names: list[str]):
    def run(batches):
        for b in by_bytes(batches, most=2 << 20):
            out = np.full(b.num_rows, model.empty if model else 0.0)
            if model:
                s, begins = symbols(b.column("text"))
                at, value = word_values(s, model.table)
                if len(at):
                    text = np.searchsorted(begins, at, side="right") - 1
                    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                    best = np.maximum.reduceat(value, first).astype(np.float64) + model.bias
                    out[text[first]] = 1 / (1 + np.exp(-np.clip(best * model.slope + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.float64())], [*names, "score"])
    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (with ``text``) plus ``score`` from 0 to 1, higher for toxic.

    Null, empty and wordless texts get the score of a text without evidence; all
    texts get 0 if ``model`` is None. An input column ``score`` is replaced.
    """
    names = [c for c in docs.columns if c != "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*names).mapInArrow(_score(model, names), f"{kinds}, score double")
