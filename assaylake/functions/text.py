"""Text normal forms and predicates as Column expressions.

They make comparison keys; stored text is never rewritten. Unicode compatibility folding is the
one step without a built-in, and goes through an Arrow UDF.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic characters and what a comparison key has in their place.
TYPOGRAPHY = {
    " ": " ", " ": " ", " ": " ",
    "−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
    "‘": "'", "’": "'", "“": '"', "”": '"',
    "­": "",
    "∙": "·", "⋅": "·",
}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two lower-cased texts; 0 if either is empty."""
    one = lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _typography(c: Column) -> Column:
    single = {k: v for k, v in TYPOGRAPHY.items() if v}
    return F.translate(F.regexp_replace(c, "[" + "".join(k for k, v in TYPOGRAPHY.items() if not v) + "]", ""), "".join(single), "".join(single.values()))


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def beyond_ascii(c: Column) -> Column:
    """A text with other than ASCII characters, else null: all that the Arrow UDFs could change but for case."""
    return F.when(F.octet_length(c) != F.char_length(c), c)


def collapse(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def scientific_key(c: Column, fold: bool = True) -> Column:
    """Comparison key of scientific prose; null becomes empty."""
    text = _typography(nfkc(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, r"(?<=\d)\s*◦\s*(?=[CFcf]\b)", " °")
    text = collapse(F.regexp_replace(text, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""))
    return casefold(text) if fold else text


def evidence_key(c: Column) -> Column:
    """Comparison key of an evidence snippet: NUL-tolerant, folded, white space collapsed. ASCII texts need no UDF."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(" "))
    joined = lambda x: collapse(F.regexp_replace(x, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""))
    plain = F.when(F.rlike(text, F.lit(r"[\x00-\x1F\x7F]|  |^ | $")), F.lower(joined(text))).otherwise(F.lower(text))
    return F.coalesce(casefold(joined(_typography(nfkc(beyond_ascii(text))))), plain)


def ascii_key(c: Column) -> Column:
    """Key for ASCII text, without a UDF: lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def cell_key(c: Column) -> Column:
    return collapse(nfc(F.coalesce(c, F.lit(""))))


def ocr_clean(c: Column) -> Column:
    """Composed text without control characters, blanks collapsed on each line."""
    text = F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), r"[\p{Cc}&&[^\n\t]]", "")
    return F.trim(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n"))


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(text) > 0, text).otherwise("unknown")


#: Words that a title keeps in lower case unless first.
SMALL_WORDS = ("and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "to", "vs", "with")


def humanize(c: Column) -> Column:
    """snake_case as words: first letters large, small words aside."""
    words = F.filter(F.split(F.replace(c, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    word = lambda w, i: F.when((i == 0) | ~F.lower(w).isin(*SMALL_WORDS), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))).otherwise(F.lower(w))
    return F.array_join(F.transform(words, word), " ")


def field_name(field: Column, property_name: Column | None = None) -> Column:
    prop = F.coalesce(property_name, F.lit("value")) if property_name is not None else F.lit("value")
    named = F.when(field == "value", humanize(prop)).when(field == "material_label", "Material")
    return F.when(field.isNull(), "").otherwise(named.otherwise(humanize(F.regexp_replace(field, r"^conditions\.", ""))))


def display_unit(unit: Column) -> Column:
    return F.when(unit.isin("mOhm", "milliohm", "milliohms", "mΩ"), "mΩ").otherwise(unit)


def chart_title(chart_type: Column, x: Column, y: Column, z: Column) -> Column:
    surface = chart_type.isin("heatmap", "contour") & (F.length(z) > 0)
    given = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return (
        F.when(surface, F.concat(z, F.lit(" vs "), x, F.lit(" and "), y))
        .when(given(x) & given(y), F.concat(y, F.lit(" vs "), x))
        .otherwise(F.coalesce(*(F.when(given(c), c) for c in (y, z, x)), F.lit("Visualization")))
    )


#: Patterns of secrets in log text with what replaces them, in the order they are
#: applied. A bearer credential goes first, so that no named field can take the word and leave the token.
SECRET_PATTERNS = (
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?i)(api[_ -]?key|authorization|credential|access[_ -]?token|refresh[_ -]?token|token|secret)(\s*[=:]\s*)([^\s,;'\"}]+)", "$1$2[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED_GOOGLE_API_KEY]"),
)


def redact(c: Column) -> Column:
    """Text without bearer credentials, values of named secrets and API keys."""
    for pattern, by in SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, by)
    return c


def safe_identifier(c: Column) -> Column:
    """An identifier of at most 128 plain characters that is no absolute or climbing path; else null."""
    return F.when(c.rlike(r"\A[A-Za-z0-9._-][A-Za-z0-9._/-]{0,127}\z") & ~F.contains(c, F.lit("..")), c)


def doi(c: Column) -> Column:
    """The first DOI in a text, without closing punctuation; null if there is none."""
    found = F.regexp_extract(c, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,);\]]+$", ""), F.lit(""))


def http_url(c: Column) -> Column:
    """The URL if it is http(s) with a host, else null."""
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    return F.when(scheme.isin("http", "https") & (F.length(host) > 0), c)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: F.length(s) > 0)


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a term in lower-case text: short single words on word boundaries, others anywhere."""
    plain = "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in term.lower())
    return F.regexp_count(text, F.lit(rf"\b{plain}\b" if len(term) <= 4 and " " not in term else plain))


def term_score(count: Column) -> Column:
    """Weight of a term found ``count`` times: 1, and a quarter for each of up to four repeats."""
    return F.when(count > 0, 1 + 0.25 * F.least(count - 1, F.lit(4))).otherwise(0.0)


def plural_pattern(term: str) -> str:
    """A word-bounded pattern of a term whose last word may have a plural ending."""
    escaped = r"\s+".join("".join("\\" + ch if not ch.isalnum() else ch for ch in w) for w in term.split())
    return rf"(?i)\b{escaped}(?:s|es)?\b"


def header_unit(c: Column) -> Column:
    """The unit in a column header's closing (...) or [...]."""
    return F.nullif(F.trim(F.regexp_extract(c, r"[\(\[]([^\)\]]+)[\)\]]\s*$", 1)), F.lit(""))


def looks_like_prose(c: Column) -> Column:
    """Eight words or more that end like a sentence, with letters well ahead of digits."""
    flat = collapse(c)
    letters, digits = F.regexp_count(flat, F.lit(r"\p{L}")), F.regexp_count(flat, F.lit(r"\p{Nd}"))
    ends = flat.rlike(r"[.:;]\z")
    return F.coalesce((F.size(F.split(flat, " ")) >= 8) & ends & (letters > F.greatest(F.lit(12), 2 * digits)), F.lit(False))


def strip_fence(c: Column) -> Column:
    """The inside of a text that is one fenced block."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), 0))


def snippet_overlap(a: Column, b: Column, share: float = 0.9) -> Column:
    """One text contains the other, or their token sets share 90 % of the smaller."""
    x, y = token_set(a), token_set(b)
    small = F.least(F.size(x), F.size(y))
    inside = F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    return inside | ((small > 0) & (F.size(F.array_intersect(x, y)) >= share * small))


def abbreviations(c: Column) -> Column:
    """Contents of the parentheses in a name."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), 1), lambda x: F.lower(F.trim(x)))


def name_match(actual: Column, expected: Column) -> Column:
    """Names are equal, or one is the other's parenthesised abbreviation, or equal without it."""
    bare = lambda c: F.lower(collapse(F.regexp_replace(c, r"\([^()]*\)", " ")))
    a, e = F.lower(collapse(actual)), F.lower(collapse(expected))
    return (a == e) | (bare(actual) == bare(expected)) | F.array_contains(abbreviations(actual), e) | F.array_contains(abbreviations(expected), a)


def csv_cell(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe; negative numbers don't."""
    risk = c.rlike(r"^[=+\-@]") & ~F.trim(c).rlike(r"^-\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?(?:\s*[A-Za-z%°Ωµμ/^-].*)?$")
    return F.when(c.isNull(), "").when(risk, F.concat(F.lit("'"), c)).otherwise(c)


#: Tokens by which a source says that it has no value.
MISSING_TOKENS = ("", "-", "--", "n/a", "na", "nan", "none", "null", "not reported", "nr", "n.r.", "—", "–")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_TOKENS)
