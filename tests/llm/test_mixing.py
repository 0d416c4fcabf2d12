import random
from collections import defaultdict

import numpy as np

from assaylake.llm import mixing


def water(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    want, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = want - sum(2 * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else t[s] for s in names}
        full |= over


def test_report(spark, docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 300, rng.randrange(2000)]), rng.choice(["a", "a", "a", "a", "b", "é", "z", "Z", None])) for i in range(1500)]
    rows += [(9000, "tiny source", "tiny"), (9001, "", "none"), (9002, None, "none"), (None, "x y z", "a"), (9003, "twice " * 9, "b"), (9003, "twice " * 9, "b")]
    d = docs(*rows).selectExpr("*", "1 as size", "2 as sk", "3 as unit", "4 as target")
    got = mixing.mix_report(d).collect()
    assert len(got) == len(rows)
    sizes, took, target = defaultdict(int), defaultdict(int), {}
    source = defaultdict(set)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        source[i].add(s)
    by_words = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        (s,) = source[r.doc_id]
        took[s] += r.taken
        target[s] = r.target
        by_words[s] = r.source_size
    assert by_words == dict(sizes)
    want = water(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(took[s] - want[s]) <= max(3, 0.01 * want[s]), (s, took[s], want[s])
    assert sorted(map(str, mixing.mix_report(d).collect())) == sorted(map(str, got))
    assert mixing.mix_report(d.limit(0)).count() == 0
    drawn = mixing.mixed(d.drop("size"))
    assert drawn.columns == [*d.drop("size").columns, "mix_shard"]
    words = defaultdict(int)
    for r in drawn.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in _sum(got).items() if v}


def _sum(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.doc_id] += r.taken
    return out


def test_opened_block_of_many_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 2)
    rows = [(i, "w " * (i % 40 + 1), "s" if i % 3 else "t") for i in range(3000)]
    got = mixing.mix_report(docs(*rows)).collect()
    took, target = defaultdict(int), {}
    for r in got:
        took[r.doc_id % 3 > 0] += r.taken
        target[r.doc_id % 3 > 0] = r.target
    assert all(abs(took[s] - target[s]) <= 2 for s in took)


def test_splitting_tree():
    colours = np.array([5, 0, 70, 3000, 1])
    leaves = np.array([1000, 76, 0, 1500, 500])
    got = mixing.split_tree(colours, leaves, "x")
    assert (got.sum(axis=0) == colours).all() and (got.sum(axis=1) == leaves).all() and (got >= 0).all()
    draws = np.array([mixing.split_tree(np.array([30, 10]), np.array([20, 20]), "y", i)[0] for i in range(2000)])
    assert abs(draws[:, 0].mean() - 15) < 0.15 and abs(draws[:, 0].var() - 20 * 0.75 * 0.25 * 20 / 39) < 0.25


def test_small_source_with_one_very_long_document(spark, docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(300, 450), "long") for i in range(400)] + [(999, "w " * 200_000, "long")]
    rows += [(2000 + i, "w " * 400, s) for s in "abcdef" for i in range(40 * ord(s), 40 * ord(s) + 40)]
    for seed in (11, 12):
        mix = mixing.Mix(docs(*rows), seed=seed)
        got = mix.copies(mix.placed(mix.sizes)).selectExpr("sk", "target", "size * (whole + part) as taken", "whole + part as times").collect()
        took, target = defaultdict(int), {}
        for r in got:
            took[r.sk] += r.taken
            target[r.sk] = r.target
            assert r.times <= 2
        # No document that was left out, or taken once less, would come nearer.
        assert all(abs(took[s] - target[s]) <= 225 for s in took), (seed, took, target)


def test_shards_hold_their_quotas(spark, docs):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("aaab") + str(i % 3)) for i in range(4000)]
    mix = mixing.Mix(docs(*rows), shard_words=20_000)
    leaves, draws = mix.leaves.collect(), mix.draws.collect()
    shards = {r.shard for r in leaves}
    assert len(shards) > 3
    quota, got = defaultdict(int), defaultdict(int)
    for r in leaves:
        quota[r.sk, r.shard] += r.n
    opened = {}
    for r in draws:
        if r.budget >= 0:
            opened[r.sk] = min(opened.get(r.sk, r.place), r.place)
    # Later blocks that fill a gap belong to their source's last draw.
    for r in draws:
        if r.budget < 0 or r.place == opened[r.sk]:
            got[r.sk, r.shard] += 1
    total = defaultdict(int)
    for (_, s), n in quota.items():
        total[s] += n
    assert max(total.values()) - min(total.values()) <= 1
    assert got == quota
    drawn = [(r.sk, r.block, r.place) for r in draws]
    assert len(drawn) == len(set(drawn))


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(3)
    for good, bad, n in ((40, 60, 30), (5, 1000, 700), (300, 4, 100)):
        a = [mixing.hypergeometric(good, bad, n, rng, numpy_below=0) for _ in range(4000)]
        b = rng.hypergeometric(good, bad, n, 4000)
        assert abs(np.mean(a) - b.mean()) < 0.15 * (b.std() + 0.1) and abs(np.std(a) - b.std()) < 0.15 * (b.std() + 0.1)
        assert min(a) >= max(0, n - bad) and max(a) <= min(good, n)
    x = mixing.draw(np.array([3 * 10**9, 10**9, 5]), 2 * 10**9, rng)
    assert x.sum() == 2 * 10**9 and abs(x[0] - 1.5e9) < 1e6
