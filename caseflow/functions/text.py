"""Column-level text operators.

Every function takes and returns :class:`pyspark.sql.Column`, so the work stays
inside whole-stage codegen; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
CASE_REF_STRICT = r"\[(SGCON/[0-9]{4}/[0-9]+)\]"         # case reference in text
CASE_REF_LOOSE = r"\[([A-Za-z0-9/_-]+)\]"                # installer hint pattern
FILE_STEM = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"             # file name without its extension
SOP_TITLE = r"SOP_(.+)\.pdf$"                           # procedure title in file name
SUBJECT_TYPE = r"\[SGCON[^\]]*\]\s*(.+?)\s*-\s"        # recorded type in subject
DATE_TOKEN = r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})"       # "05 Jan 2024"
DATE_TOKEN_FORMAT = "d MMM yyyy"
NATIONAL_ID = r"[STFG][0-9]{7}[A-Z]"                     # national id number
JSON_OBJECT = r"(?s)[{].*[}]"                           # greedy first { .. last }
NUMBERED_STEP = r"^\s*\d+\.\s+"                          # "1. step text"
REDACTED = "***REDACTED***"
NRIC_TOKEN = "[NRIC]"
NAME_TOKEN = "[NAME]"
CASE_PREVIEW_CHARS = 280
SOP_PREVIEW_CHARS = 500


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(c) -> Column:
    """``nullif(c, '')``: regexp_extract yields '' on no match."""
    c = _c(c)
    return F.when(c != F.lit(""), c)


# --- X3 / X4 ----------------------------------------------------------------

def case_ref(text) -> Column:
    """Strict case reference; NULL (not '') when the text holds none (Q1)."""
    return blank_to_null(F.regexp_extract(_c(text), CASE_REF_STRICT, 1))


def case_ref_hint(text) -> Column:
    """Loose bracketed token, as the installer's PDF mode reads it."""
    return F.regexp_extract(_c(text), CASE_REF_LOOSE, 1)


def case_ref_fallback(hint, path) -> Column:
    """Hint if present, else the file name stem, else NULL."""
    return F.coalesce(blank_to_null(hint), blank_to_null(F.regexp_extract(_c(path), FILE_STEM, 1)))


# --- X11 ----------------------------------------------------------------------

def subject_case_type(text) -> Column:
    """Recorded type: text between ``[SGCON..]`` and the first `` - ``.

    A subject wrapped before the hyphen gives NULL (reference: '').
    """
    return blank_to_null(F.regexp_extract(_c(text), SUBJECT_TYPE, 1))


def recorded_case_type(text, model_type, source: str = "subject") -> Column:
    """The record's type by ``source``: read from the ``subject`` line, or as the ``model`` extracted it."""
    if source not in ("subject", "model"):
        raise ValueError(f"case_type_source is subject or model, not {source!r}")
    return subject_case_type(text) if source == "subject" else blank_to_null(_c(model_type))


# --- X15 / X16 ------------------------------------------------------------------

def date_tokens(text) -> Column:
    """All ``d Mon yyyy`` tokens in text order."""
    return F.regexp_extract_all(_c(text), F.lit(DATE_TOKEN), 1)


def parse_token_date(tok) -> Column:
    """Strict date parse; a token such as ``05 abc 2024`` gives NULL (Q8)."""
    return F.try_to_date(_c(tok), DATE_TOKEN_FORMAT)


def resolution_days(status, text, method: str = "text") -> Column:
    """Days from first to last date of a closed case.

    ``method="text"`` (default) takes the first and last token in text order,
    which may be negative (Q7); ``"minmax"`` takes earliest to latest.
    Open cases and texts with fewer than two tokens give NULL.
    """
    toks = date_tokens(text)
    closed = F.lower(_c(status)) == F.lit("closed")
    if method == "text":
        first = parse_token_date(F.try_element_at(toks, F.lit(1)))
        last = parse_token_date(F.try_element_at(toks, F.lit(-1)))
    elif method == "minmax":
        dates = F.transform(toks, parse_token_date)
        first, last = F.array_min(dates), F.array_max(dates)
    else:
        raise ValueError(method)
    return F.when(closed & (F.size(toks) >= 2), F.datediff(last, first)).cast("int")


# --- X7 / X24 -------------------------------------------------------------------

def json_cut(raw) -> Column:
    """Greedy ``{...}`` cut out of model chatter ('' when no braces)."""
    return F.regexp_extract(_c(raw), JSON_OBJECT, 0)


def json_array_or_empty(raw) -> Column:
    """JSON text to ``array<string>``; bad input or non-array gives ``[]``."""
    arr = F.from_json(_c(raw), "array<string>")
    return F.coalesce(arr, F.array().cast("array<string>"))


# --- X1 -------------------------------------------------------------------------

def flatten_elements(elements) -> Column:
    """``elements[].content`` joined by newline; NULL contents are skipped."""
    return F.concat_ws("\n", F.transform(_c(elements), lambda e: e.getField("content")))


# --- X19 / X20 / X21 / X22 / X23 ------------------------------------------------

def sop_title(path) -> Column:
    return F.regexp_extract(_c(path), SOP_TITLE, 1)


def norm_key(x) -> Column:
    """Lower-case letters only: ``Serious_Illness_Death`` = ``Serious Illness/Death``."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z]", "")


def numbered_steps(text) -> Column:
    """Numbered lines of a procedure, number stripped, in order (wrapped
    continuation lines are dropped, as in the reference)."""
    lines = F.split(_c(text), r"\r?\n")
    kept = F.filter(lines, lambda ln: ln.rlike(NUMBERED_STEP))
    return F.transform(kept, lambda ln: F.trim(F.regexp_replace(ln, r"^\s*\d+\.\s*", "")))


def case_preview(text, n: int = CASE_PREVIEW_CHARS) -> Column:
    """First ``n`` characters followed by ``...`` (always appended)."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def head_chars(text, n: int = SOP_PREVIEW_CHARS) -> Column:
    return F.substring(_c(text), 1, n)


def title_words(title) -> Column:
    """File-name title to words: ``_`` becomes a blank."""
    return F.regexp_replace(_c(title), "_", " ")


# Punctuation folded to ASCII before the Latin-1 check.
FOLD_FROM = "—–’“”"   # em dash, en dash, right single quote, left/right double quotes
FOLD_TO = "--'\"\""


def fold_text(text) -> Column:
    """Long dashes and curly quotes to ASCII; other non-Latin-1 chars to ``?``."""
    t = F.translate(_c(text), FOLD_FROM, FOLD_TO)
    return F.regexp_replace(t, "[^\\x{00}-\\x{FF}]", "?")


# --- G1 / G3 --------------------------------------------------------------------

def mask(value, privileged) -> Column:
    """Value for privileged viewers, else ``***REDACTED***`` (NULL too, Q5)."""
    priv = privileged if isinstance(privileged, Column) else F.lit(bool(privileged))
    return F.when(priv, _c(value)).otherwise(F.lit(REDACTED))


def scrub_ids(text) -> Column:
    return F.regexp_replace(_c(text), NATIONAL_ID, NRIC_TOKEN)


def scrub_pii(text, name) -> Column:
    """National ids to ``[NRIC]``, then the exact name to ``[NAME]``.

    A NULL or empty name leaves the id-scrubbed text (the reference returns a
    NULL chunk there, Q4).
    """
    ids = scrub_ids(text)
    nm = _c(name)
    return F.when(nm.isNull() | (nm == F.lit("")), ids).otherwise(F.replace(ids, nm, F.lit(NAME_TOKEN)))


def has_national_id(text) -> Column:
    return _c(text).rlike(NATIONAL_ID)


# --- X25 ------------------------------------------------------------------------

def fixed_chunks(text, size: int = 1000) -> Column:
    """Array of consecutive ``size``-character pieces (empty text: no piece)."""
    t = _c(text)
    n = F.ceil(F.length(t) / F.lit(size)).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.substring(t, i * size + 1, size))
