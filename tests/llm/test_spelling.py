import random
import re
import zlib
from collections import Counter, defaultdict

from assaylake.llm import spelling


def brute(rows, min_chars=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= min_chars and k >= min_count}
    near, like = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            like[i, shorter].add(w)
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in like.values():
        for a in group:
            near[a] |= group - {a}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_equals_brute_force_on_dense_words(spark, docs):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            base = list(rng.choice(["banane", "bananen", "straße", "ÀÉÎõü÷", "abcabc", "aaaaaaa", "zyxwvu"]))
            if rng.random() < 0.3:
                base[rng.randrange(len(base))] = rng.choice("abnÿ×")
            words.append("".join(base).upper() if rng.random() < 0.1 else "".join(base))
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    d = docs(*rows).selectExpr("*", "1 as word", "2 as n", "3 as mask")
    want = brute(rows)
    assert len(want) > 50 and any(r[1] for r in want)
    assert found(spelling.spelling_groups(d)) == want


def test_chains_reach_their_last_form(spark, docs):
    steps = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    text = " ".join(w for k, w in enumerate(steps) for _ in range(5 * 6**k))
    rows = [(None, text)]
    got = found(spelling.spelling_groups(docs(*rows)))
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "aaabbb"


def test_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "Letters letters"), (3, "letters " * 4), (3, "letters " * 4), (4, "lettres " * 7), (5, "x" * 100_000), (6, ("y" * 5000 + " ") * 9), (7, ("y" * 4999 + " ") * 60)]
    assert found(spelling.spelling_groups(docs(*rows))) == brute(rows)
    assert spelling.spelling_groups(docs(*rows).limit(0)).count() == 0
    assert spelling.spelling_groups(docs((1, "short words only"))).count() == 0


def test_near_words_share_a_band(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéîõüÿ") for _ in range(rng.randrange(6, 20)))
        i, c = rng.randrange(len(w)), rng.choice("abcxyzéÿ")
        pairs.append((w, rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])))
    masks = spark.createDataFrame(pairs, "u string, v string").select(spelling.letter_mask(spelling.F.col("u")), spelling.letter_mask(spelling.F.col("v"))).collect()
    for a, b in masks:
        flipped = (a ^ b) & (2**64 - 1)
        assert bin(flipped).count("1") <= 2
        assert any(flipped >> low & ((1 << width) - 1) == 0 for low, width in spelling.BANDS)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spelling.query(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_a_run_left_by_a_picked_one_is_not_picked_again(spark, docs):
    """Of document 66 the hash picks both runs, and the longer one leaves the shorter one."""
    rows = [(66, ("a" * 262 + " ") * 6 + ("a" * 261 + " ") * 7)]
    want = brute(rows)
    assert [r[3] for r in want] == [7, 6]
    assert found(spelling.spelling_groups(docs(*rows))) == want
