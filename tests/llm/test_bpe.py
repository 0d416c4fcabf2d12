import hashlib
import random

import pytest

from assaylake.llm import bpe, tokens

PIECES = ["the ", "Straße ", "don't ", "1234", "\n\n", "é ", "éx", "😀", "<|endoftext|>", " <|startoftext|> ", "...", "\x0b", "\xa0", "  ", "'s", "日本語", "ﬁ ", "İ "]
PIECES += ["a" * 70, "x" * 200, "\x1c", "\x85", " ", "²", "ΑΣ ", "Σ", "\xad", "º", "'LL", "ŉ", "ǅ", "가", "﻿", "<|endoftext"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name):
    path = tokens.tokenizer_path(name)
    codec, library = bpe.Bpe(path), tokens.load(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += ["a" + chr(c) + "b " + chr(c) * 2 for c in range(0x250)]
    texts += ["ab" * 3000, "x" * 5000, "é" * 999, "!" * 3000, "anan" * 50, "", " "]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.code(text) == (bpe.pack(want), library.decode(want, skip_special_tokens=False))
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_scan_and_heap_agree():
    codec = bpe.Bpe(tokens.tokenizer_path())
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 90)))
        assert codec._scan(word) == codec._heap(word)


def test_forgets_words():
    codec, library = bpe.Bpe(tokens.tokenizer_path()), tokens.load(tokens.tokenizer_path())
    codec.known[True].most = 6
    text = "one two three four five six one two three"
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(codec.known[True]) <= 3 and len(codec.known[True].older) <= 3


def test_rows(spark, docs):
    d = docs((1, "Hello, WORLD"), (2, None), (3, ""), (None, "a b"), (1, "Hello, WORLD"), (4, "word " * 3000), (5, "z" * 100_000)).selectExpr("*", "1 as ids", "2 as n_tokens")
    library = tokens.load(tokens.tokenizer_path())

    def want(r):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), text

    expected = sorted(map(want, d.collect()), key=str)
    encoded = bpe.encode_documents(d, batch_bytes=1000)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encoded.collect()), key=str) == expected
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted(map(tuple, bpe.digests(encoded).collect()), key=str)
    assert digests == sorted(((i, n, sha(ids), sha(text.encode())) for i, n, ids, text in expected), key=str)
    assert bpe.encode_documents(d.limit(0)).count() == 0


def test_query_equals_the_library(spark):
    library = tokens.load(tokens.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.query(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
