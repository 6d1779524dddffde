"""Token counts of whole texts, huge documents by overlap resynchronisation.

Method. A text of at most ``huge`` characters is encoded in one go. A longer one
becomes overlapping chunks, dealt over all tasks and encoded with offsets. Two
neighbouring encodings are spliced at a boundary they share inside their
overlap: a place where both start a new pre-token and which lies far enough
before the left chunk's end that nothing behind that end could have moved it.
From such a place on both encodings see the same text and have no memory, so
they agree; the splice is proven. A document with a pair of chunks that share no
such place is encoded again with a wider overlap, in the end as one chunk.

Encoding in one go uses the same fact in its simplest forms: a single space
between two characters that are not white space always starts a pre-token, and
one ends where letters, digits or signs do. So the tokens of a text are the
tokens of its words and signs, and each distinct one is encoded once while it is
in a bounded cache.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import stage

BPE_FILE = "byte_bpe_50k.json"
HUGE = 32_768       # characters; longer texts are cut into chunks
STEP = 16_384       # characters from one chunk's start to the next
OVERLAP = 512       # first overlap in characters; eight times wider on each new try
MARGIN = 32         # characters before a chunk's end that are not proven; over any added token's length
CACHE = 600_000     # distinct words kept by a worker; then the cache starts anew
SLICE = 256         # documents handled at a time, so memory follows single documents

_OTHER_BLANK = re.compile(r"[^\S ]")
_SAFE = re.compile(r"(?<=\S)(?= \S)")

# Runs that end a pre-token where they end, as the byte-level pattern takes letters, digits and other signs in runs. The
# letters are some that every Unicode version has. The apostrophe is left out of the signs, as 's and the like are
# pre-tokens. What starts otherwise stays whole up to the next single space between two characters that are not white space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯΑ-ΡΣ-ώА-ҁҊ-ԣ"
_PARTS = re.compile(rf"""
      [ ]?+ [{LETTERS}]++ (?![^\x00-\x7F])
    | [ ]?+ [!-&(-/:-@\[-`{{-~]++ (?=[{LETTERS}0-9 \n]|\Z)
    | [ ]?+ [0-9]++ (?![^\x00-\x7F])
    | (?<!\s) \n (?=\S)
    | (?s:.) [^ ]*+ (?: (?: (?<=\s)[ ] | [ ](?!\S) ) [^ ]*+ )*+
    """, re.VERBOSE)
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def tokenizer(path: str | None):
    """The tokenizer at ``path``, loaded once in a Python process.

    Functions reach the workers by value, with fresh module variables for each
    task, so what is loaded is kept on ``sys``, which lives as long as the worker.
    """
    loaded = sys.__dict__.setdefault("_caseflow_tokenizers", {})
    path = path or default_path()
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def pieces(text: str) -> tuple[str, list[str]]:
    """Cut before every single space between two characters that are not white space:
    the first piece, and the others without that space."""
    plain = "  " not in text and text[:1] != " " and text[-1:] != " " and not any(
        " " in text[max(0, m.start() - 1):m.end() + 1] for m in _OTHER_BLANK.finditer(text))
    if plain:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _SAFE.split(text)
    return first, [w[1:] for w in rest]


class WordEncoder:
    """Encodes texts part by part: token counts, or ids as little-endian bytes (``ids=True``).

    Distinct parts are encoded once while they are in a cache of bounded size,
    kept on ``sys`` like the tokenizer. New ones are encoded as one text, whose
    tokens are dealt back by their lengths in bytes, which each id has fixed."""

    def __init__(self, path: str | None, ids: bool = False):
        self.tok, self.ids = tokenizer(path), ids
        kept = sys.__dict__.setdefault("_caseflow_pieces", {})
        key = path or default_path()
        if key not in kept:
            vocab = self.tok.get_vocab(with_added_tokens=False)
            added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
            size = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
            size[list(vocab.values())] = [len(t) for t in vocab]  # byte-level: one character for each byte
            for i, content in added.items():
                size[i] = len(content.encode())
            how = json.loads(self.tok.to_str())
            byte_level = how["normalizer"] is None and _BYTE_LEVEL.items() <= (how["pre_tokenizer"] or {}).items()
            kept[key] = size, [*added.values()], byte_level
        self.size, self.added, self.byte_level = kept[key]
        self.cache = kept.setdefault((key, ids), {})
        self.heads = kept.setdefault((key, ids, "heads"), {})

    def parts(self, text: str) -> list[str]:
        """The text cut at places where a pre-token starts; one part at least."""
        if self.byte_level and not any(a in text for a in self.added):
            return _PARTS.findall(text) or [""]
        first, rest = pieces(text)
        return [first, *(" " + w for w in rest)]

    def _value(self, ids):
        return array("I", ids).tobytes() if self.ids else len(ids)

    def _add(self, parts: list[str], cache: dict) -> None:
        """Parts led by a single space follow one another; others that white space neither starts nor ends stand on lines."""
        led, lines, alone = [], [], []
        for p in parts:
            if p[:1] == " " and p[1:2].strip():
                led.append(p)
            elif p[:1].strip() and p[-1:].strip():
                lines.append(p)
            else:
                alone.append(p)
        for some, mark in ((led, ""), (lines, "\n")):
            for k in range(0, len(some), 2000):
                part = some[k:k + 2000]
                ids = np.array(self.tok.encode_batch_fast([mark.join([*part, ""])], add_special_tokens=False)[0].ids, "<u4")
                ends = np.cumsum([len(p.encode()) + len(mark) for p in part])
                at = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
                if self.ids:
                    raw, cut, less = ids.tobytes(), [0, *(at * 4).tolist()], 4 * len(mark)
                    cache.update(zip(part, (raw[a:z - less] for a, z in zip(cut, cut[1:], strict=False)), strict=True))
                else:
                    cache.update(zip(part, (np.diff(at, prepend=0) - len(mark)).tolist(), strict=True))
        cache.update(zip(alone, (self._value(e.ids) for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)), strict=True))

    def __call__(self, texts: list[str]) -> Iterator[list]:
        for cache in (self.cache, self.heads):
            if len(cache) > CACHE:
                cache.clear()
        get = self.cache.get
        firsts, found, gaps = [], [], []
        for t in texts:
            first, *rest = self.parts(t)
            values = [*map(get, rest)]  # one look-up a part; what is missing is looked up again
            firsts.append(first)
            found.append(values)
            gaps.append([(i, rest[i]) for i, v in enumerate(values) if v is None])
        self._add(list({p for g in gaps for _, p in g}), self.cache)
        for values, g in zip(found, gaps, strict=True):
            for i, p in g:
                values[i] = self.cache[p]
        self._add([p for p in set(firsts) if p not in self.heads], self.heads)
        head = self.heads.__getitem__
        return ([head(first), *values] for first, values in zip(firsts, found, strict=True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _count_whole(path: str | None):
    def run(batches):
        enc = WordEncoder(path)
        for b in slices(batches):
            counts = [sum(c) for c in enc(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])
    return run


def _cut_chunks(overlap: int, step: int):
    def run(batches):
        for b in slices(batches, 1):
            text, h1, h2 = (b.column(c)[0].as_py() for c in ("text", "h1", "h2"))
            n = len(text)
            for k, s in enumerate(range(0, max(1, n - overlap), step)):
                yield pa.RecordBatch.from_pylist(
                    [{"h1": h1, "h2": h2, "chunk": k, "start": s, "last": s + step + overlap >= n, "text": text[s:s + step + overlap]}],
                    schema=_CHUNK)
    return run


_CHUNK = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()),
                    ("text", pa.string())])
_ENCODED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()),
                      *[(c, pa.list_(pa.int64())) for c in ("head", "head_tokens", "tail", "tail_tokens")]])


def _encode_chunks(path: str | None, overlap: int, step: int):
    """Per chunk: its tokens, and the pre-token starts in both overlaps with the tokens before each."""
    def run(batches):
        tok = tokenizer(path)
        for b in slices(batches, 16):
            out = []
            for r in b.to_pylist():
                e = tok.encode(r["text"], add_special_tokens=False)
                words, size = e.word_ids, len(r["text"])
                begins = [(o[0], i) for i, o in enumerate(e.offsets) if i == 0 or words[i] != words[i - 1]]
                head = [x for x in begins if 0 < x[0] < overlap and r["chunk"]]
                tail = [x for x in begins if step < x[0] <= size - MARGIN and not r["last"]]
                out.append({"h1": r["h1"], "h2": r["h2"], "chunk": r["chunk"], "last": r["last"], "n": len(words),
                            "head": [r["start"] + p for p, _ in head], "head_tokens": [i for _, i in head],
                            "tail": [r["start"] + p for p, _ in tail], "tail_tokens": [i for _, i in tail]})
            yield pa.RecordBatch.from_pylist(out, schema=_ENCODED)
    return run


def _spark(schema: pa.Schema) -> str:
    kind = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} " + (kind.get(f.type) or "array<bigint>") for f in schema)


def _resynchronised(huge: DataFrame, path: str | None, overlap: int, step: int) -> DataFrame:
    """``huge(h1, h2, text)`` -> ``(h1, h2, n_tokens)``, one row per text; null where two chunks share no boundary."""
    chunks = huge.select("h1", "h2", "text").mapInArrow(_cut_chunks(overlap, step), _spark(_CHUNK))
    chunks = chunks.repartition(F.col("h1"), F.col("h2"), F.col("chunk"))
    enc = chunks.mapInArrow(_encode_chunks(path, overlap, step), _spark(_ENCODED))
    enc = stage(enc.dropDuplicates(["h1", "h2", "chunk"]), "chunks")  # equal texts count once
    left = enc.where("not last").select("h1", "h2", (F.col("chunk") + 1).alias("chunk"), "tail", "tail_tokens")
    pair = left.join(enc.select("h1", "h2", "chunk", "head", "head_tokens"), ["h1", "h2", "chunk"])
    at = F.array_min(F.array_intersect("tail", "head"))
    count = lambda p, t: F.get(F.col(t), F.array_position(p, F.col("at")).cast("int") - 1)
    pair = pair.withColumn("at", at).select("h1", "h2", (count("tail", "tail_tokens") - count("head", "head_tokens")).alias("n"))
    parts = pair.union(enc.where("last").select("h1", "h2", "n"))
    total = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.count("n").alias("known"))
    return total.select("h1", "h2", F.when(F.col("parts") == F.col("known"), F.col("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, huge: int = HUGE,
                 step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    Counts are those of the tokenizer file at ``path`` (default: the public
    byte-level BPE) without added special tokens; special strings inside a text
    are what the library makes of them. Null text counts as empty: 0 bytes, 0
    tokens. Null and repeated doc_ids are counted like any other row.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.where(F.length("text") <= huge).mapInArrow(_count_whole(path), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")

    big = d.where(F.length("text") > huge).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    pending, found = big, None
    while True:
        r = stage(_resynchronised(pending, path, overlap, max(step, 2 * overlap)), "counts")
        done = r.where("n_tokens is not null")
        found = done if found is None else found.union(done)
        failed = r.where("n_tokens is null").select("h1", "h2")
        if failed.isEmpty():
            break
        pending, overlap = big.join(failed, ["h1", "h2"], "left_semi"), overlap * 8
    out = out.union(big.select("h1", "h2", "doc_id", "n_bytes").join(found, ["h1", "h2"]).select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
