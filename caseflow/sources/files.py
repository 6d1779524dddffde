"""File sources: binary directory scan, pluggable parsing, bronze.

The reference parses PDFs with a hosted function. Here a *parser* is any
``Callable[[bytes], tuple[list[str], str | None]]`` (elements, error) run by
``mapInPandas`` over Arrow batches; built-ins handle plain text and HTML. HTML
can also be flattened without Python via :func:`html_elements`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import text as X

Parser = Callable[[bytes], tuple[list[str], str | None]]

PARSED_SCHEMA = ("path string, document struct<elements: array<struct<content: string>>>, "
                 "error_status string")


# --- S1 / S7 --------------------------------------------------------------------------

def scan(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """One row per file: ``path, modificationTime, length, content``.

    ``content`` is only read when selected, so counting or listing files
    (S7) never reads their bytes. Spark leaves files without bytes out; the
    lists of :mod:`caseflow.sources.landing` hold them."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", str(recursive).lower()).load(path))


def folder_size(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``(n_files, n_bytes)`` of a folder from its listing; no file is opened."""
    return scan(spark, path, glob).agg(F.count("path").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def count_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> int:
    return folder_size(spark, path, glob).first().n_files


# --- S2: parsers --------------------------------------------------------------------------

_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title", "br", "tr", "td",
          "section", "article", "header", "footer", "nav", "body", "head", "html", "ul", "ol"}
_SKIP = {"script", "style"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.buf: list[str] = []
        self.skip = 0

    def _flush(self):
        s = " ".join("".join(self.buf).split())
        if s:
            self.out.append(s)
        self.buf = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCK:
            self._flush()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK:
            self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)


def html_parser(data: bytes) -> tuple[list[str], str | None]:
    """Text blocks of an HTML page, script/style dropped."""
    p = _Blocks()
    p.feed(data.decode("utf-8", errors="replace"))
    p.close()
    p._flush()
    return p.out, None


def text_parser(data: bytes) -> tuple[list[str], str | None]:
    """Plain text: paragraphs separated by blank lines; other bytes are an error, not noise."""
    if why := not_text(data):
        return [], why
    t = data.decode("utf-8", errors="replace")
    return [" ".join(b.split()) for b in t.split("\n\n") if b.strip()], None


def _parse_batches(parser: Parser, content_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, errs = [], []
            for data in pdf[content_col]:
                try:
                    els, err = parser(bytes(data) if data is not None else b"")
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    els, err = [], f"{type(e).__name__}: {e}"
                docs.append({"elements": [{"content": s} for s in els]})
                errs.append(err)
            yield pd.DataFrame({"path": pdf["path"], "document": docs, "error_status": errs})
    return run


def parse_documents(df: DataFrame, parser: Parser = html_parser, content_col: str = "content") -> DataFrame:
    """``(path, content)`` -> ``(path, document{elements[{content}]}, error_status)``."""
    src = df.select("path", F.col(content_col).cast("binary").alias(content_col))
    return src.mapInPandas(_parse_batches(parser, content_col), PARSED_SCHEMA)


def parsed_text(parsed: DataFrame) -> DataFrame:
    """``(path, parsed_text, parse_error)``."""
    return parsed.select("path", X.flatten_elements(F.col("document.elements")).alias("parsed_text"),
                         F.col("error_status").alias("parse_error"))


def not_text(data: bytes) -> str | None:
    """Why bytes are not plain text, or None."""
    if data[:5] == b"%PDF-":
        return "pdf bytes need a parser"
    return "binary bytes need a parser" if b"\0" in data[:4096] else None


def bronze_from_files(spark: SparkSession, path: str, parser: Parser | None = None,
                      glob: str = "*") -> DataFrame:
    """Landing folder -> bronze ``(path, case_ref, parsed_text, parse_error)``.

    The reference is the strict pattern in the text, else the loose hint, else
    the file name (X3/X4)."""
    return with_reference(parsed_text(parse_documents(scan(spark, path, glob), parser or text_parser)))


def with_reference(p: DataFrame) -> DataFrame:
    """Parsed files plus their case reference."""
    ref = F.coalesce(X.case_ref("parsed_text"),
                     X.case_ref_fallback(X.case_ref_hint("parsed_text"), F.col("path")))
    return p.select("path", ref.alias("case_ref"), "parsed_text", "parse_error")


# --- X1 without Python: HTML elements by regex ---------------------------------------------

BLOCK_TAGS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|title|br|tr|td|section|article|header|footer|nav|body|head|html)\b[^>]*>"


def html_elements(html) -> Column:
    """HTML text -> ``array<struct<content>>``, whitespace collapsed, empty
    blocks dropped; script and style bodies removed; character references as written
    (the Python parser decodes them)."""
    h = X._c(html)
    h = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    h = F.regexp_replace(h, r"(?is)<style[^>]*>.*?</style>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    parts = F.split(h, BLOCK_TAGS)
    cleaned = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "),
                                                                   r"\s+", " ")))
    kept = F.filter(cleaned, lambda x: F.length(x) > 0)
    return F.transform(kept, lambda x: F.struct(x.alias("content")))


def rejects(bronze: DataFrame) -> DataFrame:
    """Documents that do not reach gold, with the reason: parse error, no text or no reference."""
    why = (F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
           .when(F.coalesce(F.length("parsed_text"), F.lit(0)) == 0, F.lit("no text"))
           .when(F.col("case_ref").isNull(), F.lit("no reference")))
    return bronze.withColumn("reason", why).where(F.col("reason").isNotNull()).select("path", "reason")
