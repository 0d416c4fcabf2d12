import random
import re
from collections import Counter, defaultdict

import pytest

from assaylake.llm import collocations
from assaylake.llm.shared import Scratch


def phrase_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                counts.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, total


def brute(rows, least=30, top=2000, cover=80):
    counts, total = phrase_counts(rows)
    counts = {p: v for p, v in counts.items() if v >= least}
    covered = set()
    for p, v in counts.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                if 100 * v >= cover * counts[q]:
                    covered.add(q)
    by_lang = defaultdict(list)
    for p, a in counts.items():
        if len(p) > 2 and p not in covered:
            cuts = [(counts[p[: 1 + k]], counts[(p[0], *p[1 + k :])]) for k in range(1, len(p) - 1)]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            by_lang[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted(
        (lang, i, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, found in by_lang.items()
        for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


def texts(n, words, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["en", "en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", "", ".", "\n", ", x"]) for _ in range(rng.randrange(40)))) for _ in range(n)]


WORDS = ["the", "The", "cat", "sat", "Über", "über", "ß", "mat", "on", "a", "a-b", "x\x00y", "zz", "zzz", "日本"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "1 as words", "2 as range", "3 as rank")


@pytest.mark.parametrize(("least", "top"), [(2, 10**6), (5, 7)])
def test_equals_brute_force(spark, least, top):
    rows = [*texts(300, WORDS), ("en", None), ("en", ""), ("en", "the cat sat " * 500), (None, "a" * 50_000 + " b"), ("en", "the cat sat " * 500)]
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least=least, top=top).collect())) == brute(rows, least, top)


@pytest.mark.parametrize(("shard_chars", "cut_chars"), [(200, 50), (3000, 400), (10**6, 10**6)])
def test_merged_tries_hold_all_counts_and_left_parts(spark, shard_chars, cut_chars):
    rows = texts(150, WORDS, seed=4) + [("en", "one two three four five. " * 60)]
    counts, total = phrase_counts(rows)
    nodes = collocations.frequent_phrases(frame(spark, rows), Scratch(spark), least=2, shard_chars=shard_chars, cut_chars=cut_chars).collect()
    assert {(r.lang, *r.words): r.f for r in nodes} == {p: v for p, v in counts.items() if v >= 2} | {(lang,): n for lang, n in total.items() if n}
    for r in nodes:
        assert r.lefts == [counts[(r.lang, *r.words[:k])] for k in range(1, len(r.words))]


def test_slices_follow_the_order_of_paths():
    rng = random.Random(9)
    rows = texts(60, WORDS, seed=5)
    trie = collocations.Trie([lang or "und" for lang, _ in rows], [t for _, t in rows])
    names = trie.words.to_pylist()
    paths = [[(str(x),) for x in trie.langs]]
    for d in range(1, 5):
        paths.append([(*paths[-1][p], names[w]) for p, w in zip(trie.parents[d], trie.labels[d], strict=True)])
    key = lambda p: [x.encode() for x in p]
    cuts = [rng.choice(rng.choice(paths)) for _ in range(40)] + [("en", "zz", "nowhere"), ("fr", "a"), ("en", "~"), ("a", "b", "c", "d", "e"), ("zz",)]
    cuts = sorted(set(cuts), key=key)
    for d, at in enumerate(trie.slices(cuts)):
        assert list(at) == [sum(key(p) < key(c) for p in paths[d]) for c in cuts]


def test_exact_beyond_64_bits(spark, monkeypatch):
    f = 9 * 10**15
    rows = [("en", [], 10**17, []), ("en", ["a"], f, []), ("en", ["b"], f + 1, []), ("en", ["a", "b"], f - 1, [f])]
    nodes = spark.createDataFrame(rows, "lang string, words array<string>, f long, lefts array<long>")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: nodes)
    (row,) = collocations.collocations(frame(spark, [("en", "x")])).collect()
    assert row.score == 2_000_000 * (f - 1) // (2 * f + 1) == 999_999


def test_empty(spark):
    assert collocations.collocations(frame(spark, [("en", "x")]).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("en", None), (None, " \t\n.")])).count() == 0
