"""Byte-pair encoding and decoding of whole texts, with the merges done here.

A word is held as one contiguous array of part boundaries beside one of the ranks of adjacent parts.
The least rank is sought by a scan, its boundary deleted, and the two neighbouring ranks are looked
up anew; that is the fastest way for words of a few dozen parts. Longer words (a text may be one) are
merged through a heap over linked parts, in n log n. Special strings, normalisation and the cut into
words are those of the tokenizer's file, by the library's own components; plain Latin texts take an
equivalent pattern where the file's components are known to agree with it.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import DROPS_SPACE_SPLIT, drops_space, load, tokenizer_path

#: Words of more parts than this are merged through the heap.
SHORT_PARTS = 96
#: Words a worker remembers with their ids, and the longest of them in characters.
MEMO_WORDS, MEMO_CHARS = 600_000, 48
#: Bytes of encoded and decoded output that one Arrow batch holds, about.
BATCH_BYTES = 8_000_000

#: No rank: the parts do not merge.
_NONE = 1 << 60

#: Characters of which NFC changes nothing, which lower-case one by one, and whose white space is known.
_PLAIN = re.compile(r"[\t\n\r -~¡-įĲ-ɏ]*")


def _plain_split() -> re.Pattern:
    """The same cut with the classes of plain characters written out."""
    lowered = sorted({x for c in range(0x250) if _PLAIN.fullmatch(chr(c)) for x in chr(c).lower()})
    of = lambda kind: "".join(x for x in lowered if unicodedata.category(x)[0] == kind)
    return re.compile(DROPS_SPACE_SPLIT.replace(r"[\p{L}]", f"[{of('L')}]").replace(r"[\p{N}]", f"[{of('N')}]").replace(r"\p{L}\p{N}", of("L") + of("N")))


class Words(dict):
    """What is known of words met before: packed ids and decoded text of each.

    When half of ``most`` words are held, they become the older half, of which those met again are kept.
    """

    def __init__(self, make, most: int = MEMO_WORDS):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.older.get(word) or self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    """The encoding and decoding of one tokenizer file of kind BPE."""

    def __init__(self, path: str):
        self.library = load(path)
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")):
            raise ValueError("only BPE without dropout, unknown tokens, prefixes of parts and byte fallback")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that are found as they are")
        self.suffix = model["end_of_word_suffix"] or ""
        self.whole_first = bool(model.get("ignore_merges"))
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        #: The same by the merged part and the length of its left one.
        self.made = {(a + b, len(a)): rank for (a, b), rank in self.ranks.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.normalizer, self.cutter, self.decoder = self.library.normalizer, self.library.pre_tokenizer, self.library.decoder
        self.plain = _plain_split() if drops_space(spec) else None
        self.letters = byte_letters()
        # Words of the plain pattern are characters, others the letters of their bytes.
        self.known = {True: Words(lambda w: self.coded(self.in_letters(w))), False: Words(self.coded)}

    def in_letters(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def coded(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word)
        return pack(ids), "" if self.decoder else self.decode(ids)

    def words(self, text: str) -> tuple[bool, list[str]]:
        """The words of a text without special strings, each of which is merged alone, and whether they are plain."""
        if self.plain is not None and _PLAIN.fullmatch(text):
            return True, self.plain.findall(text.lower())
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.cutter is None:
            return False, [text] * bool(text)
        return False, [word for word, _ in self.cutter.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The parts of a text between special strings, and these with their ids."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if at < m.start():
                yield text[at : m.start()], None
            yield m[0], self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def merge(self, word: str) -> list[int]:
        """The ids of one word, in the letters of the vocabulary."""
        if self.whole_first and (i := self.vocab.get(word + self.suffix)) is not None:
            return [i]
        return self._scan(word) if len(word) <= SHORT_PARTS else self._heap(word)

    def _scan(self, word: str) -> list[int]:
        """Boundaries and ranks as two arrays: delete the boundary of least rank until none merges."""
        text, vocab, made = word + self.suffix, self.vocab, self.made
        bounds = [*range(len(word)), len(text)]

        def rank(i: int) -> int:
            """Of the two parts that meet at bounds[i + 1]."""
            return made.get((text[bounds[i] : bounds[i + 2]], bounds[i + 1] - bounds[i]), _NONE)

        around = [rank(i) for i in range(len(word) - 1)]
        while around and (least := min(around)) < _NONE:
            at = around.index(least)
            del bounds[at + 1], around[at]
            if at < len(around):
                around[at] = rank(at)
            if at:
                around[at - 1] = rank(at - 1)
        return [vocab[text[i:j]] for i, j in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, word: str) -> list[int]:
        """Linked parts and a heap of ranks; entries of parts that have changed since are passed over."""
        ranks, end = self.ranks, len(word)
        parts: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < end:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < end and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, special strings included, as the library's without its template."""
        return unpack(self.code(text)[0])

    def code(self, text: str) -> tuple[bytes, str]:
        """The packed ids of a whole text, and the text that they decode to."""
        ids, shown = [], []
        for part, special in self.segments(text):
            if special is not None:
                ids.append(pack([special]))
                shown.append(part)
                continue
            plain, words = self.words(part)
            if words:
                packed, texts = zip(*map(self.known[plain].__getitem__, words), strict=True)
                ids.append(b"".join(packed))
                shown.append(" ".join(texts))
        packed = b"".join(ids)
        return packed, " ".join(shown) if self.decoder is None else self.decode(unpack(packed))

    def decode(self, ids: list[int]) -> str:
        """The text of some ids, special strings included: by the file's decoder, or its tokens between blanks; unknown ids are passed over."""
        tokens = [t for i in ids if (t := self.tokens.get(i)) is not None]
        return " ".join(tokens) if self.decoder is None else self.decoder.decode(tokens)


@lru_cache(maxsize=2)
def codec(path: str) -> Bpe:
    return Bpe(path)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(packed: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded text of every row of ``docs``.

    Null and empty texts have no ids and decode to the empty text; null ids and repeated rows are
    encoded like others; columns besides the two named are not read, so none can clash.
    """
    path = tokenizer_file or tokenizer_path()
    fields = [
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            begin, held, packed, texts, counts = 0, 0, [], [], []
            for i in range(b.num_rows):
                ids, text = bpe.code(b.column(1)[i].as_py() or "")
                packed.append(ids)
                texts.append(text)
                counts.append(len(ids) // 4)
                held += len(packed[-1]) + len(texts[-1])
                if held >= batch_bytes or i == b.num_rows - 1:
                    columns = [b.column(0)[begin : i + 1], pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
                    begin, held, packed, texts, counts = i + 1, 0, [], [], []

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text, of what ``encode_documents`` gives."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
