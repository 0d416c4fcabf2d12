"""Token counts of whole texts, with huge ones encoded in overlapping chunks that are spliced.

A text beyond ``chunk_chars`` is encoded chunk by chunk, each with the offsets of its tokens. Two
neighbouring chunks are spliced at a common boundary: a place in their overlap where both encodings
start a token and where the text proves that no token, no normalised character and no special
string can cross it. Where the overlap has no such place it is widened, at worst to the rest of the
text, so that counts equal those of the whole text in every case.

Shorter texts are cut at all such places; the tokens of the pieces, most of them single words that
recur, add up to those of the text and are remembered by each worker, within MEMO_CHARS.

Which places are proven follows from the tokenizer's file: its normalisation and its cut into words are
read, and only kinds whose boundaries are known are cut at all. Texts are encoded whole for others.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"

# The components of files whose words never hold white space, which is dropped.
DROPS_SPACE_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
DROPS_SPACE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space, then a plain ASCII character: such a tokenizer drops the one and starts anew at the
#: other; neither composes with its neighbours under NFC, and special strings hold no white space.
_PROVEN = re.compile(r"[ \n\t\r](?=[!-~])")
#: A single blank between plain ASCII characters: byte-level tokenizers without normalisation, which
#: cut texts into words with the blank before them, start a word at it.
_PROVEN_BLANK = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Characters of text that one call to the library gets.
_CALL_CHARS = 4_000_000
#: Characters of the pieces whose counts a worker remembers; longer pieces are counted anew each time.
MEMO_CHARS, MEMO_PIECE = 8_000_000, 64


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, once in each worker; one thread, as Spark runs one task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def drops_space(spec: dict) -> bool:
    """A tokenizer's description says that its words are runs of letters, digits or signs, and nothing is kept between."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": DROPS_SPACE_SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    same = len(steps) == 2 and steps[0] == split and {k: v for k, v in steps[1].items() if k != "trim_offsets"} == level
    return same and (spec["normalizer"] or {}).get("normalizers") == DROPS_SPACE_NORMALIZER


def proven(tokenizer) -> re.Pattern | None:
    """Where texts may be cut so that the tokens of the pieces are those of the text; None if no place is known to be one."""
    spec = json.loads(tokenizer.to_str())
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"]) for t in spec["added_tokens"])
    if plain and drops_space(spec):
        return _PROVEN
    cut = spec["pre_tokenizer"] or {}
    if plain and spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
        return _PROVEN_BLANK
    return None


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Chunk:
    """The encoding of text[begin:end], asked by places in the whole text."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        self.begin, self.end = begin, end
        self.encoding = tokenizer.encode(text[begin:end], add_special_tokens=False)

    def token_at(self, place: int) -> int | None:
        """The number of the token that starts at a place; None if none does."""
        i = self.encoding.char_to_token(place - self.begin)
        return i if i is not None and self.encoding.token_to_chars(i)[0] == place - self.begin else None


def splice(left: _Chunk, right: _Chunk, text: str) -> tuple[int, int, int] | None:
    """The last common boundary of two chunks, proven stable, with the token that starts there in each; None without one.

    Both must start a token at the place, and each place must follow white space and be ASCII.
    The first boundary's left neighbour and the last one's right neighbour lie in both chunks.
    """
    for place in reversed([m.end() for m in _PROVEN.finditer(text, right.begin, left.end)]):
        i, j = left.token_at(place), right.token_at(place)
        if i is not None and j is not None:
            return place, i, j
    return None


def count_chunked(tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """The number of tokens of ``text``, encoded at most about ``chunk_chars`` at a time."""
    total, at, first = 0, 0, 0
    left = _Chunk(tokenizer, text, 0, min(len(text), chunk_chars))
    while left.end < len(text):
        overlap, cut = min(overlap_chars, chunk_chars // 2), None
        while cut is None:
            begin = max(at, left.end - overlap)
            # A right chunk that would begin where the left one counts from is the left one, prolonged.
            until = min(len(text), begin + chunk_chars if begin > at else left.end + max(chunk_chars, left.end - at))
            right = _Chunk(tokenizer, text, begin, until)
            cut = (at, first, 0) if begin == at else splice(left, right, text)
            overlap *= 2
        total += cut[1] - first
        left, at, first = right, cut[0], cut[2]
    return total + len(left.encoding) - first


class Memo:
    """Numbers of tokens of pieces of text; forgets all of them when they exceed MEMO_CHARS characters."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.chars, self.places = tokenizer, {}, 0, proven(tokenizer)

    def count(self, pieces: set[str]) -> dict[str, int]:
        """The numbers of tokens of some pieces, at least."""
        new = [p for p in pieces if p not in self.known]
        if self.chars + sum(map(len, new)) > MEMO_CHARS:
            self.known, self.chars, new = {}, 0, list(pieces)
        found = {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found |= zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True)
        out = self.known
        if self.chars + sum(map(len, new)) <= MEMO_CHARS:
            self.known |= found
            self.chars += sum(map(len, new))
            return self.known
        return out | found


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    return Memo(load(path))


def count_batch(memo: Memo, texts: list[str], chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    out = [0] * len(texts)
    group: list[tuple[int, list[str]]] = []
    size = 0

    def flush() -> None:
        short = {p for _, pieces in group for p in pieces if len(p) <= MEMO_PIECE}
        known = memo.count(short)
        rest = [p for _, pieces in group for p in pieces if len(p) > MEMO_PIECE]
        rest = iter(memo.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        for i, pieces in group:
            out[i] = sum(known[p] if len(p) <= MEMO_PIECE else len(next(rest)) for p in pieces)

    for i, text in enumerate(texts):
        if len(text) > chunk_chars and memo.places is _PROVEN:
            out[i] = count_chunked(memo.tokenizer, text, chunk_chars, overlap_chars)
            continue
        group.append((i, memo.places.split(text) if memo.places else [text]))
        size += len(text)
        if size > _CALL_CHARS:
            flush()
            group, size = [], 0
    flush()
    return out


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, one row for each.

    Null and empty texts have 0 bytes and tokens; null ids and repeated rows are counted like
    others; columns besides the two named are not read. ``tokenizer_file`` is any .json of the
    library's; only files whose words drop white space have long texts encoded in overlapping chunks.
    """
    path = tokenizer_file or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = memo(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = pa.array(count_batch(counts, texts, chunk_chars, overlap_chars), pa.int64())
            size = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
