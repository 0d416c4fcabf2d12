import random

from assaylake.llm import lines, linking, minhash
from assaylake.llm.shared import Scratch


def find(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    real = [e for e in edges if e[0] != e[1]]
    want = find(real, {x for e in real for x in e})
    got = linking.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    assert dict(map(tuple, got.collect())) == want
    assert linking.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = find(links, range(len(rows)))
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted(((r[0], len(sets[i]), least.get(comp[i]), r[0] is not None and least[comp[i]] == r[0]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "a,"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows[-8:])[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 40, 90]))]
        rows.append((i * 3 + 1, " ".join(words)))
    return rows


def test_minhash_equals_brute_force(spark, docs):
    base = " ".join(f"b{i}" for i in range(120)).split()
    rng = random.Random(9)
    family = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        family.append((5000 + i, " ".join(w)))
    rows = corpus(4, 250) + family + [(9000 + i, "Same Text here\n" + "x " * 50) for i in range(230)] + [(9999, "same text HERE " + "x " * 50), (1, None), (2, ""), (3, " \t\n"), (None, "lone words here"), (None, None), (70000, "word " * 30000)]
    got = minhash.near_duplicates(docs(*rows).selectExpr("*", "1 as set_id", "2 as rid", "3 as key")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert minhash.near_duplicates(docs(*rows).limit(0)).count() == 0


def test_min_max_agreement_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    both, one, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 50, 50))
    same = [np.mean(minhash.signature(np.concatenate([both ^ np.uint64(k), one ^ np.uint64(k)])) == minhash.signature(np.concatenate([both ^ np.uint64(k), other ^ np.uint64(k)]))) for k in range(30)]
    assert abs(np.mean(same) - 0.8) < 0.03


def simhash(words, hashes):
    words = [w for w in words if len(w) >= lines.WORD_CHARS]
    return sum(1 << i for i in range(64) if 2 * sum(hashes[w] >> i & 1 for w in words) > len(words)) if len(words) >= lines.MIN_WORDS else None


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(spark, rows):
    from pyspark.sql import functions as F

    at = []
    for i, (doc_id, text) in enumerate(rows):
        at += [((doc_id is None, doc_id or 0), i, p, " ".join(line.split()).lower()) for p, line in enumerate(text.split("\n") if text is not None else [])]
    at = [x for x in at if len(x[3]) >= lines.MIN_CHARS]
    words = sorted({w for x in at for w in x[3].split(" ")})
    hashes = {r.w: r.h % (1 << 64) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    forms = sorted({x[3] for x in at})
    sims = [simhash(f.split(" "), hashes) for f in forms]
    links = [(i, j) for i in range(len(forms)) for j in range(i) if None not in (sims[i], sims[j]) and (sims[i] ^ sims[j]).bit_count() <= lines.APART and levenshtein(forms[i].split(" "), forms[j].split(" ")) <= 0.2 * max(len(forms[i].split(" ")), len(forms[j].split(" "))) + 1e-9]
    comp = find(links, range(len(forms)))
    group = {f: comp[i] for i, f in enumerate(forms)}
    first = {}
    for x in sorted(at, key=lambda x: (x[0], x[1], x[2])):
        first.setdefault(group[x[3]], x[1:3])
    gone = {x[1:3] for x in at if first[group[x[3]]] != x[1:3]}
    return sorted(((d, None if t is None else "\n".join(s for p, s in enumerate(t.split("\n")) if (i, p) not in gone)) for i, (d, t) in enumerate(rows)), key=str), len(links)


def test_lines_equal_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 60]))) for _ in range(40)]
    rows = []
    for i in range(120):
        out = []
        for _ in range(rng.choice([1, 3, 6])):
            w = rng.choice(pool).split(" ")
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w[k] = w[k] + rng.choice(["x", "", "yy"])
            out.append(rng.choice(["  ", ""]) + " ".join(w).title())
        rows.append((i, "\n".join(out + rng.choice([[], ["", "ok"], ["   "]]))))
    rows += [(500 + i, "a very common line, said by all of them\nown line number %d here" % (i * i * 7919)) for i in range(240)] + [(900, None), (901, ""), (None, "a very common line, said by all of them"), (902, "\n\n"), (903, ("long word " * 3000).strip())]
    want, n = brute_lines(spark, rows)
    got = lines.dedup_lines(docs(*rows).selectExpr("*", "1 as kept_text", "2 as dk", "3 as pos", "4 as drop")).collect()
    assert n > 5
    assert sorted(((r.doc_id, r.kept_text) for r in got), key=str) == want
    assert lines.dedup_lines(docs(*rows).limit(0)).count() == 0
    repeated = lines.dedup_lines(docs((1, "the same text twice"), (1, "the same text twice"), (2, "The  same text twice\nplus another line"))).collect()
    assert sorted(r.kept_text for r in repeated) == ["plus another line", "the same text twice", "the same text twice"]


def test_lines_run_no_python(spark, docs):
    plan = lines.dedup_lines(docs((1, "a line that is here"), (2, "a line that is here")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tiles_of_a_large_family(spark, docs, monkeypatch):
    rng = random.Random(12)
    rows, text = [], [f"v{i}" for i in range(60)]
    for i in range(300):
        w = list(text)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"c{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            text[rng.randrange(60)] = f"d{i}"
    want = brute(rows)
    for tile in (512, 40, 8):
        monkeypatch.setattr(minhash, "TILE_SETS", tile)
        assert sorted(map(tuple, minhash.near_duplicates(docs(*rows)).collect()), key=str) == want


def test_one_document_of_each_group_stays(spark, docs):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (9, None), (10, ""), (None, "q r s t u v"), (11, "one"), (12, "one"), (13, "other words here")]
    out = minhash.without_near_duplicates(docs(*rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, "a b c d e f g h"), (9, None), (10, ""), (None, "q r s t u v"), (11, "one"), (13, "other words here")], key=str)


def test_lines_stage(spark, docs):
    rows = [(1, "first line of the text\nsecond line of the text"), (2, "first line of the text"), (3, ""), (4, None), (5, "  First   line of THE text\n\n"), (6, "first line of the text\nanother line stays")]
    out = lines.without_repeats(docs(*rows))
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted([(1, rows[0][1], 46), (3, "", 0), (4, None, None), (6, "another line stays", 18)], key=str)


def test_bucket_masks_meet_all_near_hashes():
    rng = random.Random(8)
    masks = lines.bucket_masks()
    assert len(masks) == 20 and all(31 <= m.bit_count() <= 33 for m in masks)
    for _ in range(3000):
        apart = sum(1 << i for i in rng.sample(range(64), 3))
        assert any(not apart & m for m in masks)


def test_lines_meet_at_the_edit_similarity(spark, docs):
    rng = random.Random(21)
    rows, n = [], 0
    for size in (5, 6, 8, 10, 12, 13, 15, 16, 20, 30, 60):
        for turn in range(12):
            words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            other = list(words)
            for k in rng.sample(range(size), size // 5):
                other[k] = f"z{rng.randrange(10**9)}"
            if turn % 4 == 1:  # edits as far apart as can be
                other = [f"z{rng.randrange(10**9)}" if k % 5 == 4 else w for k, w in enumerate(words)]
            if turn % 4 == 2:
                other = words[: size - size // 5]
            rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
            n += 1
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs(*rows)).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_lines_of_short_words_meet(spark, docs):
    rows = [(1, "add to my cart now and pay 10"), (2, "add to my cart now and pay 20"), (3, "a b c d e f g h"), (4, "a b x d e f g h"), (5, "no two of us are in it at all"), (6, "a b c q r s t u v")]
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs(*rows)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


def test_very_long_lines_meet(spark, docs):
    rng = random.Random(6)
    words = [f"word{rng.randrange(10**6)}" for _ in range(5000)]
    other = [f"z{i}" if i % 50 == 7 else w for i, w in enumerate(words)]
    apart = [f"word{rng.randrange(10**6)}" for _ in range(5000)]
    got = lines.dedup_lines(docs((1, " ".join(words)), (2, " ".join(other)), (3, " ".join(apart)))).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 1, 3: 0}


def test_buckets_that_many_lines_share_lose_no_link(spark, docs, monkeypatch):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(12))) for i in range(400)]
    want, n = brute_lines(spark, rows)
    assert n > 50
    for tile in (2048, 40):
        monkeypatch.setattr(linking, "TILE_ROWS", tile)
        got = lines.dedup_lines(docs(*rows)).collect()
        assert sorted(((r.doc_id, r.kept_text) for r in got), key=str) == want
