import random

import pytest

from assaylake.llm import tokens


def whole(t, text):
    return len(t.encode(text, add_special_tokens=False))


def test_chunked_counts_equal_whole_counts():
    t = tokens.load(tokens.tokenizer_path())
    rng = random.Random(1)
    pieces = ["the ", "Straße ", "don't ", "1234", "\n\n", "é ", "́x", "😀", "<|endoftext|>", "...", "ñandú", "  ", "'s", "日本語", " ", " z", "ﬁ ", "İ ", "a" * 40]
    for n in (0, 1, 7, 60, 300, 900):
        for chunk, overlap in ((16, 4), (64, 8), (200, 20), (1000, 1)):
            text = "".join(rng.choice(pieces) for _ in range(n))
            assert tokens.count_chunked(t, text, chunk, overlap) == whole(t, text), (n, chunk, overlap)


def test_widens_without_any_stable_place():
    t = tokens.load(tokens.tokenizer_path())
    for text in ("ab" * 3000, "日" * 2000, "x" * 700 + " " + "y" * 5000, "é" * 999 + " é" * 500, "!" * 3000, "<|endoftext|>" * 300):
        assert tokens.count_chunked(t, text, 100, 10) == whole(t, text)


def test_rows(spark, docs):
    d = docs((1, "hello world"), (2, None), (3, ""), (None, "a b"), (1, "hello world"), (4, "word " * 3000), (5, "z" * 200_000)).selectExpr("*", "1 as n_tokens", "2 as tokens")
    got = sorted(map(tuple, tokens.count_tokens(d).collect()), key=str)
    t = tokens.load(tokens.tokenizer_path())
    want = sorted(((r.doc_id, len((r.text or "").encode()), whole(t, r.text or ""), whole(t, r.text or "") > 2048) for r in d.collect()), key=str)
    assert got == want
    assert tokens.count_tokens(d.limit(0)).count() == 0


def test_remembered_pieces_add_up(monkeypatch):
    t = tokens.load(tokens.tokenizer_path())
    rng = random.Random(4)
    pieces = ["the ", "Straße ", "don't ", "1234", "\n\n", "é ", "́x", "😀", "<|endoftext|>", " <|startoftext|> ", "...", "\x0b", " ", "  ", "'s", "日本語", "ﬁ ", "İ ", "a" * 70]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(80))) for _ in range(300)]
    want = [whole(t, x) for x in texts]
    for most in (0, 300, 10**6):
        monkeypatch.setattr(tokens, "MEMO_CHARS", most)
        memo = tokens.Memo(t)
        assert tokens.count_batch(memo, texts) == want and tokens.count_batch(memo, texts, 64, 8) == want
        assert memo.chars <= most and memo.chars == sum(map(len, memo.known))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_public_tokenizer(spark, docs, name):
    t = tokens.load(tokens.tokenizer_path(name))
    rng = random.Random(8)
    pieces = ["the ", " the", "Straße ", "don't ", "1234", "\n\n", " \n x", "é ", "\u0301x", "<|endoftext|>", " <|endoftext|> ", "...", "\xa0", "  a", "\t", "b  ", "'s", " ", "日本語 ", "a" * 70]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(120))) for _ in range(120)] + ["word " * 9000, " " * 40_000, "x y" * 20_000, "ab" * 30_000]
    got = tokens.count_tokens(docs(*enumerate(texts)), tokenizer_file=tokens.tokenizer_path(name)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: whole(t, x) for i, x in enumerate(texts)}


def test_unknown_kinds_are_encoded_whole(tmp_path, spark, docs):
    import json

    spec = json.loads(tokens.load(tokens.tokenizer_path("byte_bpe_50k.json")).to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    t = tokens.load(str(tmp_path / "t.json"))
    assert tokens.proven(t) is None
    texts = ["one two three", "", " a b", "x" * 40_000 + " y"]
    got = tokens.count_tokens(docs(*enumerate(texts)), tokenizer_file=str(tmp_path / "t.json")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: whole(t, x) for i, x in enumerate(texts)}
