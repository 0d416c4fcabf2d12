"""Whole-text document statistics in numpy: one row of numbers for each text, one pass over its bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Counted from each text, in this order. Words are runs of anything but ASCII white space.
COUNTS = (
    "n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_lower", "n_digit", "n_exclaim",
    "n_pipe", "n_stop", "n_comma", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_top", "n_letters_only",
)

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CLASSES = {
    "n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_lower": bytes(range(97, 123)), "n_digit": b"0123456789",
    "n_exclaim": b"!", "n_pipe": b"|", "n_stop": b".?;:", "n_comma": b",", "n_space": _SPACE, "n_tail": bytes(range(128, 192)),
}
_TABLE = np.array([[byte in members for members in _CLASSES.values()] for byte in range(256)], dtype=np.int64)
_AT = {name: i for i, name in enumerate(_CLASSES)}


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, its first occurrence included."""
    if len(words) <= width:
        return 0
    grams = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    twice = np.fromiter((seen[g] > 1 for g in grams), dtype=bool, count=len(grams)).nonzero()[0]
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + width, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def counts(text: bytes) -> list[int]:
    """The COUNTS of one UTF-8 text; null counts as empty, which has zeros throughout."""
    by = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _TABLE
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    forms = Counter(words)
    n_chars = len(text) - int(by[_AT["n_tail"]])
    alpha = sum(n for w, n in forms.items() if w.isalpha())
    named = {k: int(by[_AT[k]]) for k in _CLASSES}
    return [
        len(text), n_chars, len(words), n_chars - named["n_space"], named["n_symbols"], named["n_upper"], named["n_lower"], named["n_digit"], named["n_exclaim"],
        named["n_pipe"], named["n_stop"], named["n_comma"], len(lines), len(lines) - len(set(lines)), repeat_words(words), len(forms), max(forms.values(), default=0), alpha,
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text of a string column."""
    rows = [counts(x or b"") for x in texts.cast(pa.large_binary()).to_pylist()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS...) of every row of ``docs``; other columns are not read, null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[:, j]) for j in range(m.shape[1]))], ["doc_id", *COUNTS])

    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(id_col, text_col).mapInArrow(run, out)


#: Ratios and logarithms of the counts: what the models see.
FEATURES = (
    "log_words", "word_length", "symbol_ratio", "upper_ratio", "digit_ratio", "exclaim_ratio", "pipe_ratio", "stop_ratio", "comma_ratio",
    "line_words", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "top_ratio", "alpha_ratio", "non_ascii_ratio",
)


#: Added to the denominators, so that the ratios of a few words stay near zero.
PRIOR_WORDS = 10


def features(m: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS; every ratio of an empty text is 0."""
    c = {k: m[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    words, chars, lines = c["n_words"] + PRIOR_WORDS, c["word_chars"] + 5 * PRIOR_WORDS, c["n_lines"] + 1
    ascii_ = c["n_upper"] + c["n_lower"] + c["n_digit"] + c["n_symbols"] + c["n_exclaim"] + c["n_stop"] + c["n_comma"]
    out = [
        np.log1p(c["n_words"]), c["word_chars"] / np.maximum(c["n_words"], 1), c["n_symbols"] / chars, c["n_upper"] / chars, c["n_digit"] / chars, c["n_exclaim"] / words, c["n_pipe"] / words,
        c["n_stop"] / words, c["n_comma"] / words, np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, (c["n_words"] - c["n_distinct"]) / words ** 1.2,
        np.maximum(c["n_top"] - 1, 0) / words, c["n_letters_only"] / words, np.maximum(c["word_chars"] - ascii_, 0) / chars,
    ]
    return np.stack(out, axis=1) if len(m) else np.zeros((0, len(FEATURES)))
