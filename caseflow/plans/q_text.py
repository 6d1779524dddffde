"""Text, parsing, extraction and source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import record as R
from caseflow.functions import text as X
from caseflow.operators import extract as E
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register
from caseflow.session import checkpoint_dir
from caseflow.sources import files as FL
from caseflow.sources import landing as LD
from caseflow.sources import tables as TB
from caseflow.sources.tables import Tables, spread

# --- X1 / S2 on pages -------------------------------------------------------------

_HTML_SQL = r"""list_filter(list_transform(string_split_regex(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
                   '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '(?i)</?(p|div|h[1-6]|li|ul|ol|title|br|tr|td|section|article|header|footer|nav|body|head|html)\b[^>]*>'),
  lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))),
  lambda x: length(x) > 0)"""


@register("flatten_elements", f"""
SELECT page_id, CAST(len(els) AS INTEGER) AS n_elements, array_to_string(els, chr(10)) AS parsed_text
FROM (SELECT page_id, {_HTML_SQL} AS els FROM pages)""", ops=("X1", "S2"))
def flatten_elements(spark, d):
    """HTML page -> text blocks -> one newline-joined text per page."""
    p = spread(Tables(spark, d).pages)
    els = FL.html_elements("html")
    return p.select("page_id", F.size(els).alias("n_elements"), X.flatten_elements(els).alias("parsed_text"))


# The parser's blocks: script and style out, one block between block tags, references decoded.
_PARSED_SQL = r"""list_filter(list_transform(string_split_regex(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
                   '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '(?i)</?(p|div|h[1-6]|li|ul|ol|title|br|tr|td|section|article|header|footer|nav|body|head|html)\b[^>]*>'),
  lambda x: trim(regexp_replace(html_unescape(regexp_replace(x, '<[^>]*>', '', 'g')), '\s+', ' ', 'g'))),
  lambda x: length(x) > 0)"""
def _decoded(c: str) -> str:
    # the character references that the pages hold; &amp; last, so that nothing is decoded twice
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{ref}', '{char}')"
    return c


_PARSED_SQL = _PARSED_SQL.replace("html_unescape(regexp_replace(x, '<[^>]*>', '', 'g'))", _decoded("regexp_replace(x, '<[^>]*>', '', 'g')"))


@register("parse_pages", f"""
SELECT url AS path, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5, CAST(NULL AS VARCHAR) AS parse_error
FROM (SELECT url, array_to_string({_PARSED_SQL}, chr(10)) AS t FROM pages)""", ops=("S2", "X1", "X2"))
def parse_pages(spark, d):
    """Pluggable parser (stdlib HTML) over page bytes via mapInPandas."""
    p = Tables(spark, d).pages.select(F.col("url").alias("path"), F.col("html").alias("content"))
    parsed = FL.parsed_text(FL.parse_documents(p, FL.html_parser))
    return parsed.select("path", F.length("parsed_text").alias("n_chars"), F.md5("parsed_text").alias("text_md5"), "parse_error")


#: Bronze of the pages as files: references come from the text or the file name.
PARSED_PAGES_SQL = rf"""
SELECT path, coalesce(nullif(regexp_extract(t, '\[(SGCON/[0-9]{{4}}/[0-9]+)\]', 1), ''),
                      nullif(regexp_extract(t, '\[([A-Za-z0-9/_-]+)\]', 1), ''),
                      regexp_extract(path, '([^/]+?)(?:\.[A-Za-z0-9]+)?$', 1)) AS case_ref,
       md5(t) AS text_md5, CAST(NULL AS VARCHAR) AS parse_error
FROM (SELECT 'landing/page_' || page_id || '.html' AS path, array_to_string({_PARSED_SQL}, chr(10)) AS t FROM pages)"""


def page_files(spark, d):
    """``(path, html)``: the pages under file names."""
    return Tables(spark, d).pages.select(
        F.concat(F.lit("landing/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")


def landed_pages(spark, d):
    """A folder in the shared store with one file for each page, and the pages' names in it."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    return LD.land(page_files(spark, d), folder, "path", "html")


def _name_in(folder):
    """The part of ``path`` below the folder."""
    return F.substring_index(F.col("path"), folder.rstrip("/").rpartition("/")[2] + "/", -1)


@register("src_binary_scan", PARSED_PAGES_SQL, ops=("S1", "S2", "X4"))
def src_binary_scan(spark, d):
    """Pages landed as files, read back as bytes -> parse -> bronze with file-name fallback reference."""
    folder = landed_pages(spark, d)
    files = FL.scan(spark, folder, "*.html").select(_name_in(folder).alias("path"), "content")
    out = FL.with_reference(FL.parsed_text(FL.parse_documents(files, FL.html_parser)))
    return out.select("path", "case_ref", F.md5("parsed_text").alias("text_md5"), "parse_error")


@register("count_landing", """
SELECT s AS seen_by, CASE WHEN s = 'large' THEN count(*) FILTER (n >= 3000) ELSE count(*) END AS n_files,
       CAST(CASE WHEN s = 'large' THEN coalesce(sum(n) FILTER (n >= 3000), 0) ELSE sum(n) END AS BIGINT) AS n_bytes
FROM (SELECT strlen(html) AS n FROM pages), (SELECT unnest(['folder', 'loads', 'large']) AS s) GROUP BY s""", ops=("S7", "S1"))
def count_landing(spark, d):
    """Files and bytes of a landing folder: by the folder's listing, by its loads' lists, and of its large files; none is opened."""
    folder = landed_pages(spark, d)
    listed, large = (LD.documents(spark, folder, "*.html", content=False, **o) for o in ({}, {"minLength": 3000}))
    count = F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")
    parts = (("folder", FL.folder_size(spark, folder, "*.html")), ("loads", listed.agg(*count)),
             ("large", large.agg(*count)))
    first, *rest = [p.select(F.lit(s).alias("seen_by"), "n_files", "n_bytes") for s, p in parts]
    return first.union(rest[0]).union(rest[1])


# --- X7 / X8: JSON cut and typed decode on events -----------------------------------------

_RAW = ("CASE event_type WHEN 'error' THEN props || ' and ' || props WHEN 'view' THEN 'no json here' "
        "ELSE 'Sure! ' || props || ' Hope this helps.' END")


def _raw_answer():
    et, props = F.col("event_type"), F.col("props")
    return (F.when(et == "error", F.concat(props, F.lit(" and "), props))
            .when(et == "view", F.lit("no json here"))
            .otherwise(F.concat(F.lit("Sure! "), props, F.lit(" Hope this helps."))))


@register("json_cut", f"""
SELECT event_id, cut,
       CASE WHEN json_valid(first) THEN json_extract_string(first, '$.k') END AS k,
       CASE WHEN raw IS NULL THEN 'no_answer' WHEN cut = '' THEN 'no_json'
            WHEN NOT json_valid(first) THEN 'bad_json' ELSE 'ok' END AS status
FROM (SELECT event_id, raw, cut, regexp_extract(cut, '^[{{][^{{}}]*[}}]', 0) AS first
      FROM (SELECT event_id, raw, regexp_extract(raw, '(?s)[{{].*[}}]', 0) AS cut
            FROM (SELECT event_id, {_RAW} AS raw FROM events)))""", ops=("X7", "X8", "X10"))
def json_cut(spark, d):
    """Model-style answers -> greedy JSON cut -> decode -> failure kind."""
    ev = Tables(spark, d).events.select("event_id", _raw_answer().alias("raw"))
    dec = E.decode(F.col("raw"), T.StructType([T.StructField("k", T.StringType())]))
    return ev.select("event_id", X.json_cut("raw").alias("cut"), dec.alias("dec"), "raw") \
        .select("event_id", "cut", F.col("dec.k").alias("k"), E.decode_status(F.col("raw"), F.col("dec")).alias("status"))


_L1_SHOWN = [f for f in R.L1_FIELDS if f in S.RECORD_EXPRS]


@register("decode_l1", S.on_threads("SELECT case_ref, CAST(" + " + ".join(
    f"CAST(({S.record_expr(f)}) IS NOT NULL AS INTEGER)" for f in R.L1_FIELDS) + " AS INTEGER) AS n_l1_fields, "
    + ", ".join(f"{S.record_expr(f)} AS {f}" for f in _L1_SHOWN) + " FROM threads"), ops=("X8",))
def decode_l1(spark, d):
    """Typed decode of a 25-field layer-1 answer, written as JSON from every case."""
    record = FX.record_from_l1(FX.l1_model_stand_in(FX.threads(spark, d)))
    fields = F.struct(*[F.col(f).alias(f) for f in R.L1_FIELDS])
    raw = F.concat(F.lit("Here it is: "), F.to_json(fields, {"ignoreNullFields": "false"}), F.lit(" done"))
    js = record.select(F.col("Case_Ref").alias("case_ref"), E.decode(raw, R.l1_struct_type()).alias("js"))
    present = sum(F.when(F.col("js").getField(f).isNotNull(), 1).otherwise(0) for f in R.L1_FIELDS)
    return js.select("case_ref", present.cast("int").alias("n_l1_fields"), *[F.col("js").getField(f).alias(f) for f in _L1_SHOWN])


@register("json_array_or_empty", S.on_cases("""
SELECT Case_Ref, array_to_string(arr, ',') AS items, CAST(len(arr) AS INTEGER) AS n FROM (
  SELECT Case_Ref, coalesce(try(from_json(raw, '["VARCHAR"]')), CAST([] AS VARCHAR[])) AS arr
  FROM (SELECT Case_Ref, CASE Case_Status WHEN 'Closed' THEN CAST(to_json(L1_Situational_Flags) AS VARCHAR)
                              WHEN 'Pending' THEN '{"a": 1}'
                              ELSE '[' || array_to_string(L1_Situational_Flags, ',') END AS raw FROM cases))"""),
          ops=("X24",))
def json_array_or_empty(spark, d):
    """JSON text -> array; malformed or non-array -> []."""
    g = FX.cases(spark, d)
    raw = (F.when(F.col("Case_Status") == "Closed", F.to_json("L1_Situational_Flags"))
           .when(F.col("Case_Status") == "Pending", F.lit('{"a": 1}'))
           .otherwise(F.concat(F.lit("["), F.concat_ws(",", "L1_Situational_Flags"))))
    arr = X.json_array_or_empty(raw)
    return g.select("Case_Ref", F.concat_ws(",", arr).alias("items"), F.size(arr).alias("n"))


@register("model_extract_stub", S.on_threads(r"""
SELECT case_ref, CASE WHEN t = '' THEN 'no_json' ELSE 'ok' END AS status, CAST(NULL AS VARCHAR) AS error,
       nullif(t, '') AS Case_Type, nullif(regexp_extract(parsed_text, '\]\s*(.+?)\s*-\s*(.+?) in ', 2), '') AS Title_Name
FROM (SELECT *, regexp_extract(parsed_text, '\]\s*(.+?)\s*-\s*(.+?) in ', 1) AS t FROM threads)"""), ops=("X5", "X6", "X7", "X8", "X12"))
def model_extract_stub(spark, d):
    """Plug point: batched offline model over every thread, staged once,
    decoded with failure kinds kept."""
    th = FX.threads(spark, d).select("case_ref", "parsed_text")
    ex = E.extract(th, E.offline_model, E.l1_prompt(), R.l1_struct_type())
    return ex.select("case_ref", "status", "error", F.col("js.Case_Type").alias("Case_Type"),
                     F.col("js.Title_Name").alias("Title_Name"))


# --- X22 / X23 / X25 on documents ----------------------------------------------------------

@register("preview_text", """
SELECT doc_id, substring(text, 1, 280) || '...' AS preview, md5(substring(text, 1, 500)) AS head_md5
FROM documents""", ops=("X22",))
def preview_text(spark, d):
    """Evidence preview: first 280 characters plus '...'; 500-char head."""
    doc = spread(Tables(spark, d).documents)
    return doc.select("doc_id", X.case_preview("text").alias("preview"), F.md5(X.head_chars("text")).alias("head_md5"))


@register("fold_text", r"""
SELECT doc_id, md5(f) AS folded_md5, CAST(length(f) - length(replace(f, '?', '')) AS INTEGER) AS n_q
FROM (SELECT doc_id, regexp_replace(translate(text, '—–’“”', '--''""'), '[^\x{00}-\x{FF}]', '?', 'g') AS f
      FROM documents)""", ops=("X23",))
def fold_text(spark, d):
    """Punctuation to ASCII, other non-Latin-1 characters to '?'."""
    doc = spread(Tables(spark, d).documents)
    f = X.fold_text("text")
    return doc.select("doc_id", F.md5(f).alias("folded_md5"),
                      (F.length(f) - F.length(F.replace(f, F.lit("?"), F.lit("")))).alias("n_q"))


@register("chunk_fixed", """
SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS chunk_md5
FROM (SELECT doc_id, i, substring(text, i * 1000 + 1, 1000) AS c
      FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i) r)""",
          ops=("X25",))
def chunk_fixed(spark, d):
    """Fixed 1000-character chunks of every document (whole texts)."""
    doc = spread(Tables(spark, d).documents)
    ch = doc.select("doc_id", F.posexplode(X.fixed_chunks("text", 1000)).alias("pos", "c"))
    return ch.select("doc_id", F.col("pos").cast("int").alias("pos"), F.length("c").alias("n_chars"),
                     F.md5("c").alias("chunk_md5"))


# --- S3-S5, X4, X19, X20 -----------------------------------------------------------------------

@register("src_parsed_table", """
SELECT CAST(doc_id AS VARCHAR) AS case_ref, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM documents""",
          ops=("S3", "S6"))
def src_parsed_table(spark, d):
    """Adopt an already parsed table with caller-chosen key and text columns."""
    b = TB.ingest(spark, "parsed_table", source=Tables(spark, d).documents, ref_col="doc_id", text_col="text")
    return b.select("case_ref", F.md5("parsed_text").alias("text_md5"), F.length("parsed_text").alias("n_chars"))


_NARRATIVE_SQL = ("concat_ws(' ', " + ", ".join(f"coalesce({S.record_expr(c)}, '')" for c in TB.NARRATIVE_COLUMNS)
                  + ")")


@register("src_case_table", S.on_threads(f"SELECT case_ref, {_NARRATIVE_SQL} AS parsed_text FROM threads"),
          ops=("S4", "S5", "S6", "K7"))
def src_case_table(spark, d):
    """Adopt a record table (extra columns allowed) and derive its narrative."""
    rec = FX.record_from_l1(FX.l1_model_stand_in(FX.threads(spark, d)))
    missing = R.check_record_schema(rec)
    if missing:
        raise ValueError(missing)
    return TB.ingest(spark, "case_table", source=rec.withColumn("extra_col", F.lit(1)))


@register("case_ref_fallback", r"""
SELECT doc_id, coalesce(nullif(regexp_extract(text, '\[([A-Za-z0-9/_-]+)\]', 1), ''),
                        nullif(regexp_extract('/landing/doc_' || CAST(doc_id AS VARCHAR) || '.pdf', '([^/]+)\.pdf$', 1), ''))
       AS case_ref FROM documents""", ops=("X4", "X3"))
def case_ref_fallback(spark, d):
    """Loose bracket hint in the text, else the file-name stem."""
    doc = spread(Tables(spark, d).documents)
    path = F.concat(F.lit("/landing/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return doc.select("doc_id", X.case_ref_fallback(X.case_ref_hint("text"), path).alias("case_ref"))


@register("sop_title", S.on_cases(r"""
SELECT Case_Ref, title, regexp_replace(title, '_', ' ', 'g') AS title_words,
       regexp_replace(lower(title), '[^a-z]', '', 'g') = regexp_replace(lower(Case_Type), '[^a-z]', '', 'g') AS same_key
FROM (SELECT Case_Ref, Case_Type,
             regexp_extract('/landing/SOP_' || regexp_replace(Case_Type, '[/ ]', '_', 'g') || '.pdf',
                            'SOP_(.+)\.pdf$', 1) AS title FROM cases)"""), ops=("X19", "X20", "X22"))
def sop_title(spark, d):
    """Title from a procedure file name; normalised key equals the type's."""
    g = FX.cases(spark, d)
    path = F.concat(F.lit("/landing/SOP_"), F.regexp_replace("Case_Type", "[/ ]", "_"), F.lit(".pdf"))
    t = X.sop_title(path)
    return g.select("Case_Ref", t.alias("title"), X.title_words(t).alias("title_words"),
                    (X.norm_key(t) == X.norm_key("Case_Type")).alias("same_key"))


@register("sop_chunks_from_files", S.on_threads(r"""
SELECT 'SOP_' || t AS chunk_id, t AS sop_title,
       'Procedure: ' || Case_Type || chr(10) || string_agg(n || '. Visit ' || n_name || '.', chr(10) ORDER BY n) AS chunk
FROM (SELECT Case_Type, n_name, row_number() OVER (PARTITION BY Case_Type ORDER BY n_name) AS n,
             regexp_replace(Case_Type, '[/ ]', '_', 'g') AS t
      FROM (SELECT DISTINCT case_type AS Case_Type, n_name FROM facts WHERE n_name IS NOT NULL))
GROUP BY Case_Type, t"""), ops=("V2", "S1", "S2", "X1", "X19"))
def sop_chunks_from_files(spark, d):
    """Procedure files derived from the cases (one per type, a step per nation): parse -> title from the name -> chunk."""
    from pyspark.sql import Window

    from caseflow.plans.rebuild import sop_chunks
    g = FX.stored_cases(spark, d).select("Case_Type", "Case_Location").where("Case_Location is not null").distinct()
    n = F.row_number().over(Window.partitionBy("Case_Type").orderBy("Case_Location"))
    steps = g.select("Case_Type", n.alias("n"), F.concat(n.cast("string"), F.lit(". Visit "), "Case_Location", F.lit(".")).alias("s"))
    body = steps.groupBy("Case_Type").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x"))
    text = F.concat_ws("\n\n", F.concat(F.lit("Procedure: "), "Case_Type"), F.transform("x", lambda v: v["s"]))
    files = body.select(F.concat(F.lit("landing/SOP_"), F.regexp_replace("Case_Type", "[/ ]", "_"), F.lit(".txt")).alias("path"),
                        text.cast("binary").alias("content"))
    return sop_chunks(FL.parsed_text(FL.parse_documents(files, FL.text_parser)))
