"""Text shaping, fence extraction and query terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Must equal the reference for matching results.
FENCE = "```"
QUERY_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from",
    "give", "how", "in", "is", "it", "list", "me", "of", "on", "or", "please",
    "show", "that", "the", "their", "to", "was", "were", "what", "when", "where",
    "which", "who", "with",
]
VALUE_TYPE_MARKERS = ["TEXT", "CHAR", "CLOB", "DATE", "DATETIME"]

_SPACE = r"[\s\x1c-\x1f]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def one_line(c: Column) -> Column:
    """Collapse every run of white space to one blank and trim; null becomes ''. Single blanks, which
    are most runs, are left alone."""
    runs = rf"(?U)[\s\x1c-\x1f&&[^ ]]{_SPACE}*| {_SPACE}+"
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), runs, " "))


def quote_identifier(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only, so that 'É' and 'é' stay different names."""
    return F.translate(c, _UPPER, _UPPER.lower())


#: Lower-case characters whose case fold is longer or another letter.
_FOLDS = {
    "ß": "ss", "ς": "σ", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn",
}


def casefold(c: Column) -> Column:
    """Lower case with the folds above; texts without such characters take the short way."""
    folded = lower = F.lower(c)
    for letter, fold in _FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(fold))
    return F.when(lower.rlike("[" + "".join(_FOLDS) + "]"), folded).otherwise(lower)


def _mark_table() -> tuple[str, str]:
    """Lower-case letters with marks, of all scripts that use them, and their base letters."""
    marked, base = [], []
    for code in (*range(0x00DF, 0x0530), *range(0x1E00, 0x2000)):
        letter = chr(code)
        first, *rest = unicodedata.normalize("NFD", letter)
        if letter.islower() and rest and all(unicodedata.combining(m) for m in rest):
            marked.append(letter)
            base.append(first)
    return "".join(marked), "".join(base)


def strip_marks(c: Column) -> Column:
    """Base letters of composed and of decomposed letters."""
    marked, base = _mark_table()
    return F.regexp_replace(F.translate(c, marked, base), "[\u0300-\u036f]+", "")


def search_tokens(c: Column) -> Column:
    """Index tokens: runs of letters and digits, folded, without marks. Texts of ASCII characters
    alone, which need no folds, take the short way."""
    plain = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))
    folded = F.regexp_extract_all(strip_marks(casefold(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.when(F.octet_length(c) == F.char_length(c), plain).otherwise(folded)


def query_phrases(question: Column, evidence: Column) -> Column:
    """Distinct search terms of a question in order of first appearance, each (term, tokens): a term
    such as first_name is a phrase whose tokens have to stand next to each other."""
    text = casefold(F.concat_ws(" ", question, evidence))
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))
    words = F.transform(words, lambda w: F.regexp_replace(w, "^_+|_+$", ""))
    kept = F.filter(
        words,
        lambda w: (w != "")
        & ~w.isin(QUERY_STOP_WORDS)
        & ((F.length(w) > 1) | w.rlike(r"^\p{Nd}$")),
    )
    tokens = F.transform(
        F.array_distinct(kept),
        lambda w: F.struct(
            w.alias("term"),
            F.regexp_extract_all(strip_marks(w), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("tokens"),
        ),
    )
    return F.filter(tokens, lambda t: F.size(t["tokens"]) > 0)


def is_value_type(declared: Column) -> Column:
    upper = F.upper(F.coalesce(declared, F.lit("")))
    return upper.rlike("|".join(VALUE_TYPE_MARKERS))


def normalize_value(c: Column, max_chars: int | None) -> Column:
    """One-line value; null when blank or longer than ``max_chars``."""
    line = one_line(c)
    keep = line != ""
    if max_chars is not None:
        keep = keep & (F.length(line) <= max_chars)
    return F.when(keep, line)


def _extraction(sql: Column, status: str, compliant: bool, reasoning: Column) -> Column:
    return F.struct(
        reasoning.alias("reasoning"),
        sql.alias("predicted_sql"),
        F.lit(status).alias("extraction_status"),
        F.lit(compliant).alias("format_compliance"),
    )


def extract_sql(raw: Column) -> Column:
    """Plain form: the first fence that matches decides, even when its body is bad."""
    text = strip(raw)
    none = F.lit("")
    failed = _extraction(none, "failed", False, none)
    # The patterns must equal the reference for matching results.
    fenced = r"(?is)\A```sql[ \t]*\r?\n(.*?)\r?\n```\z"
    generic = r"(?s)\A```[ \t]*\r?\n(.*?)\r?\n```\z"

    def from_fence(pattern: str, status: str, compliant: bool) -> Column:
        body = F.regexp_extract(text, pattern, 1)
        good = ~F.contains(body, F.lit(FENCE)) & (strip(body) != "")
        return F.when(good, _extraction(strip(body), status, compliant, none)).otherwise(failed)

    return (
        F.when(text.rlike(fenced), from_fence(fenced, "sql_fence", True))
        .when(text.rlike(generic), from_fence(generic, "generic_fence", False))
        .when(text.rlike(r"(?i)\A(?:SELECT|WITH)(?U:\b)"), _extraction(text, "raw_sql", False, none))
        .otherwise(failed)
    )


def extract_reasoning_sql(raw: Column) -> Column:
    """Reasoning form: a bad body falls through to the next, weaker form."""
    text = strip(raw)
    none = F.lit("")
    think = (
        r"(?is)\A<think>\s*(.*?)\s*</think>\s*"
        r"```sql[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"
    )
    fenced = r"(?is)\A```sql[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"
    generic = r"(?s)\A```[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"

    def usable(body: Column) -> Column:
        return (body != "") & ~F.contains(body, F.lit(FENCE))

    reasoning = strip(F.regexp_extract(text, think, 1))
    thought_sql = strip(F.regexp_extract(text, think, 2))
    fenced_sql = strip(F.regexp_extract(text, fenced, 1))
    generic_sql = strip(F.regexp_extract(text, generic, 1))
    return (
        F.when(
            usable(reasoning) & usable(thought_sql),
            _extraction(thought_sql, "reasoning_sql_fence", True, reasoning),
        )
        .when(usable(fenced_sql), _extraction(fenced_sql, "sql_fence", False, none))
        .when(usable(generic_sql), _extraction(generic_sql, "generic_fence", False, none))
        .when(text.rlike(r"(?i)\A(?:SELECT|WITH)(?U:\b)"), _extraction(text, "raw_sql", False, none))
        .otherwise(_extraction(none, "failed", False, none))
    )


def extract_rationale(raw: Column) -> Column:
    """Body of the single rationale block, or null."""
    pattern = r"(?s)\A<RATIONALE>[ \t]*\r?\n(.+?)\r?\n</RATIONALE>\z"
    return F.nullif(strip(F.regexp_extract(strip(raw), pattern, 1)), F.lit(""))


def wrap_sql(sql: Column) -> Column:
    """Assistant text that carries one statement."""
    return F.concat(F.lit("```sql\n"), sql, F.lit("\n```"))


def sample_id(split: Column, source_index: Column) -> Column:
    """'<split>_<index>' with the index padded to six digits, never cut."""
    digits = source_index.cast("string")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(6) - F.length(digits)))
    return F.concat(split, F.lit("_"), zeros, digits)
