"""Language ID: script ranges, per-word scores, Viterbi over the words of a text.

Method. A model holds, for each learned language, log-odds of hashed byte
trigrams (with the blanks around a word) and its share of letters in each script
range. A word is scored only for languages whose training text uses the word's
script. Viterbi with a switching penalty then labels the words of a text, so a
mixed text comes out as spans; the language with most labelled bytes is the
text's.

All words of a batch run through Viterbi together: blocks of ``BLOCK`` words give
best scores from each first to each last language, a short pass per text joins
its blocks, and a last pass labels the words inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import hash_sample
from caseflow.llm.hashing import _joined, by_bytes

BUCKETS = 1 << 16
SAMPLE = 400        # training texts for each language
SWITCH = 12.0       # price of a change of language, in nats
MIN_SHARE = 0.002   # of a language's letters in a script, for the script to count as its own
BLOCK = 64
UNKNOWN = "und"

#: Script of a letter by its code point: first code point of each range (fixed Unicode blocks).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1300, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
]
NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))


def _letter_table() -> np.ndarray:
    """Folded byte: ASCII letters lower-case, other ASCII a blank, other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[65:91] = t[97:123] = np.arange(97, 123)
    return t


def _words(texts: pa.Array):
    """(folded bytes, word starts, word ends, first word of each text plus the number of words)."""
    data, offsets = _joined(texts)
    b = _letter_table()[data]
    blank = np.empty(len(b) + 1, bool)
    blank[0] = True
    blank[1:] = b == 32
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    return b, turn[::2], turn[1::2], np.searchsorted(turn[::2], offsets)


def _trigrams(b: np.ndarray) -> np.ndarray:
    """Bucket of the bytes around each byte."""
    x = np.concatenate(([32], b, [32])).astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32)


def _scripts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of each word: that of its highest letter range."""
    if not len(starts):
        return np.zeros(0, np.int64)
    x = np.concatenate((b, [0, 0])).astype(np.int32)
    lead, one, two = x[:-2], x[1:-1], x[2:]
    code = np.where(lead < 0x80, 97, 0)
    code = np.where((lead >= 0xC2) & (lead < 0xE0), (lead & 31) << 6 | one & 63, code)
    code = np.where((lead >= 0xE0) & (lead < 0xF0), (lead & 15) << 12 | (one & 63) << 6 | two & 63, code)
    code = np.where(lead >= 0xF0, 0x3400, code)  # beyond the basic plane: mostly Han
    top = np.maximum.reduceat(np.where(b == 32, 0, code), starts)
    number = np.array([NAMES.index(n) for _, n in SCRIPTS])
    return number[np.searchsorted([c for c, _ in SCRIPTS], top, side="right") - 1]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scores: np.ndarray   # language x bucket, log-probabilities
    allowed: np.ndarray  # script x language


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of ``docs(doc_id, text, lang)``, from at most ``sample`` texts a language, chosen by hash.

    Rows with a null text, language or doc_id are left out. None if no row is left.
    The texts are counted where they lie; only one table a language comes back.
    """
    d = docs.where("doc_id is not null and text is not null and lang is not null")
    some = hash_sample(d.select("lang", "doc_id"), "lang", sample)
    few = F.broadcast(some.select("doc_id").distinct())  # sample x languages rows at most
    parts = d.join(few, "doc_id", "left_semi").select("lang", "text").mapInArrow(_count, "lang string, counts binary")
    rows = parts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").orderBy("lang").collect()
    if not rows:
        return None
    c = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], np.float64)
    grams, letters = c[:, :BUCKETS] + 0.1, c[:, BUCKETS:]
    share = letters / np.maximum(1, letters.sum(axis=1, keepdims=True))
    return Model([r["lang"] for r in rows], np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32),
                 (share >= MIN_SHARE).T)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in by_bytes(batches):
        lang = np.array(b.column("lang").to_pylist())
        for name in np.unique(lang):
            data, starts, ends, _ = _words(b.column("text").filter(pa.array(lang == name)))
            t = total.setdefault(str(name), np.zeros(BUCKETS + len(NAMES), np.int64))
            t[:BUCKETS] += np.bincount(_trigrams(data)[data != 32], minlength=BUCKETS)
            t[BUCKETS:] += np.bincount(_scripts(data, starts), ends - starts, len(NAMES)).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                                         ["lang", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": table.column("lang")[:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})


def _word_scores(model: Model, b, starts, ends) -> np.ndarray:
    grams = _trigrams(b)
    grams[b == 32] = -1
    out = np.empty((len(starts), len(model.langs)), np.float32)
    for k, table in enumerate(model.scores):
        out[:, k] = np.add.reduceat(np.append(table, np.float32(0))[grams], starts) if len(starts) else 0
    ok = model.allowed[_scripts(b, starts)]
    ok[~ok.any(axis=1)] = True  # a script no language was seen with narrows nothing
    return np.where(ok, out, np.float32(-1e6))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; ``first`` = first word of each text plus the number of words."""
    n, langs = scores.shape
    if not n or langs == 1:
        return np.zeros(n, np.int64)
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    begin = np.concatenate(([0], np.cumsum(blocks)))
    text = np.repeat(np.arange(len(size)), size)
    pos = np.arange(n) - first[text]
    x = np.zeros((begin[-1], BLOCK, langs), np.float32)  # words past a text's end score nothing, so they keep its last language
    x[begin[text] + pos // BLOCK, pos % BLOCK] = scores
    low = np.float32(-1e30)

    # best score from each first language (axis 1) to each last language of a block
    v = np.where(np.eye(langs, dtype=bool), x[:, 0][:, :, None], low)
    for t in range(1, BLOCK):
        v = np.maximum(v, v.max(axis=2, keepdims=True) - switch) + x[:, t][:, None, :]

    # joins the blocks of a text, longest texts first so that the ones left are a prefix
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] > 0]
    left = np.searchsorted(-blocks[order], -np.arange(blocks.max()), side="left")
    enter, came = np.zeros((begin[-1], langs), np.int16), np.zeros((begin[-1], langs), np.int16)
    best = np.zeros((len(order), langs), np.float32)
    for k in range(int(blocks.max())):
        live = order[:left[k]]
        at, old = begin[live] + k, best[:len(live)]
        top = old.argmax(axis=1)
        moved = np.take_along_axis(old, top[:, None], 1) - (switch if k else 0)
        stay = (old >= moved) & (k > 0)
        total = np.where(stay, old, moved)[:, :, None] + v[at]
        enter[at] = total.argmax(axis=1)
        best[:len(live)] = new = total.max(axis=1)
        best[:len(live)] -= new.max(axis=1, keepdims=True)  # keeps long texts within single precision
        came[at] = np.where(stay, np.arange(langs), top[:, None])
    last = best.argmax(axis=1)
    head, tail = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.int64)
    for k in range(int(blocks.max()) - 1, -1, -1):
        live = left[k]
        at = begin[order[:live]] + k
        tail[at] = last[:live]
        head[at] = enter[at, last[:live]]
        last[:live] = came[at, head[at]]

    # labels the words of all blocks, whose first and last languages are now known
    rows = np.arange(begin[-1])
    v = np.full((begin[-1], langs), low)
    v[rows, head] = x[rows, 0, head]
    stays, tops = np.ones((BLOCK, begin[-1], langs), bool), np.zeros((BLOCK, begin[-1]), np.int16)
    for t in range(1, BLOCK):
        tops[t] = v.argmax(axis=1)
        moved = v.max(axis=1, keepdims=True) - switch
        stays[t] = v >= moved
        v = np.maximum(v, moved) + x[:, t]
    labels = np.empty((begin[-1], BLOCK), np.int16)
    labels[:, BLOCK - 1] = now = tail
    for t in range(BLOCK - 1, 0, -1):
        now = np.where(stays[t, rows, now], now, tops[t])
        labels[:, t - 1] = now
    return labels[begin[text] + pos // BLOCK, pos % BLOCK].astype(np.int64)


def _label(model: Model | None, switch: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in by_bytes(batches, most=4 << 20):
            texts, pred, score, spans = b.column("text").to_pylist(), [], [], []
            data, starts, ends, first = _words(b.column("text"))
            if model:
                label = viterbi(_word_scores(model, data, starts, ends), first, switch)
                turn = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if len(label) else np.zeros(0, np.int64)
            for i, text in enumerate(texts):
                a, z = int(first[i]), int(first[i + 1])
                if not model or a == z or not (text.isascii() or any(map(str.isalpha, text))):
                    pred.append(UNKNOWN), score.append(0.0), spans.append([])
                    continue
                size = np.bincount(label[a:z], ends[a:z] - starts[a:z], len(model.langs))
                k = int(size.argmax())
                pred.append(model.langs[k])
                score.append(float(size[k] / size.sum()))
                cut = [a, *turn[np.searchsorted(turn, a, "right"):np.searchsorted(turn, z, "left")].tolist(), z]
                spans.append([{"lang": model.langs[label[s]], "start": s - a, "end": e - a} for s, e in zip(cut, cut[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(pred), pa.array(score, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
                [*names, "lang_pred", "score", "spans"])
    return run


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """``docs`` (with ``text``) plus ``lang_pred``, ``score`` and ``spans``.

    ``lang_pred`` = the language of most labelled bytes (the first by name on
    ties), ``score`` = its share from 0 to 1, ``spans`` = runs of one language as
    ``(lang, start, end)`` in words (runs of letters), end excluded. A text that
    is null or has no letter: ``und``, 0, no spans; so has every text if ``model``
    is None. Input columns of the three names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*names).mapInArrow(_label(model, switch, names), f"{kinds}, lang_pred string, score double, "
                                          "spans array<struct<lang:string,start:int,end:int>>")


def held_out(doc_id: Column, fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == fold, F.lit(False))
