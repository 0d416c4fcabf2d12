import random
from collections import defaultdict

from assaylake.llm import packing


def simulate(sizes, lengths, opens):
    """Best fit, largest first, one item at a time; bins as [length, used]."""
    bins = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= s]
        if fit:
            min(fit, key=lambda b: b[0] - b[1])[1] += s
        else:
            bins.append([opens(s), s])
    return sorted((min(x for x in lengths if x >= u), u) for _, u in bins)


def test_bulk_best_fit_equals_one_at_a_time():
    rng = random.Random(1)
    for lengths in ((16,), (8, 16, 32), (5, 7, 31)):
        for n in (1, 10, 200):
            sizes = [rng.randrange(1, lengths[-1] + 1) for _ in range(n)]
            histogram = {s: sizes.count(s) for s in sizes}
            for opens in (lambda s, x=lengths: x[-1], lambda s, x=lengths: min(y for y in x if y >= s)):
                p = packing.best_fit(histogram, lengths, opens)
                want = simulate(sizes, lengths, opens)
                assert p.total == sum(packing.cost(x) for x, _ in want)


def test_pieces(spark, docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 30, 511, 512, 700, 2047, rng.randrange(3000)])) for i in range(400)]
    rows += [(1000 + i, "same size text " * 40) for i in range(500)] + [(None, "a b"), (None, "a b"), (2000, None), (2001, "x " * 20_000), (1, "w w w")]
    d = docs(*rows).selectExpr("*", "1 as size", "2 as rank", "3 as bin_id")
    got = packing.pack_documents(d).collect()
    words = defaultdict(int)
    pieces = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        words[r.doc_id] += r["size"]
        pieces[r.doc_id] += 1
        assert (r["size"] == 0) == (r.bin_id is None) and r.start == r.piece * packing.LENGTHS[-1]
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r["size"], r.length))
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len((t or "").split())
    assert words == want and pieces[2001] == 5
    for held in bins.values():
        at = 0
        for offset, size, length in sorted(held):
            assert offset == at
            at += size
        assert at <= held[0][2] and held[0][2] in packing.LENGTHS and all(x < at for x in packing.LENGTHS if x < held[0][2])
    used = sum(s for b in bins.values() for _, s, _ in b)
    assert used / sum(b[0][2] for b in bins.values()) > 0.9
    key = lambda r: str(tuple(r))
    assert sorted(map(key, packing.pack_documents(d).collect())) == sorted(map(key, got))
    assert packing.pack_documents(d.limit(0)).count() == 0
