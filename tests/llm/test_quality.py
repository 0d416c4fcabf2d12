import random
import zlib

import numpy as np
import pyarrow as pa

from assaylake.llm import docstats, quality, rules

from .conftest import DOCS, LABELS

DATA = "/root/testdata/sf0.01"


def plain_counts(text):
    b = (text or "").encode()
    words = b.split()
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), chars, symbols, dup, len(hit)


TEXTS = [None, "", " \n\t ", "a b a b a b", "x\ny\nx\n\nx \n", "ein Straße # |é| <ok>", "a b c a b c d", "one two\x1cthree four", "tok " * 400, "a" * 50_000, "%$&* " * 30]


def test_base_counts():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("ab cd é # \n".split(" ")) for _ in range(rng.randrange(60))) for _ in range(60)]
    m = docstats.matrix(pa.array(texts, pa.string()))
    at = [docstats.COUNTS.index(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert [tuple(int(x) for x in row[at]) for row in m] == [plain_counts(t) for t in texts]
    assert np.isfinite(docstats.features(m)).all()


def test_discriminant_equals_its_formula():
    rng = np.random.default_rng(1)
    d = len(docstats.FEATURES)
    by = {}
    for k in (0, 1):
        x = rng.normal(k, 1 + k, size=(500, d))
        by[k] = (500, x.sum(axis=0), x.T @ x)
    model = quality.fit(by)
    x = np.abs(rng.normal(0.5, 1, size=(20, d)))
    z = np.clip((quality.transform(x) - model.centre) / model.scale, -8, 8)
    logs = []
    for k in (0, 1):
        s = np.linalg.inv(model.inverses[k].T @ model.inverses[k])
        assert np.allclose(s, s.T)
        e = z - model.means[k]
        logs.append(np.log(0.5) * quality.TEMPERATURE - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality.TEMPERATURE))
    assert np.allclose(model.score(x), want)
    assert quality.fit({0: (0, None, None), 1: (3, None, None)}).score(x).tolist() == [1.0] * 20
    assert quality.fit({0: (0, None, None), 1: (0, None, None)}).score(x).tolist() == [1.0] * 20
    assert quality.fit({0: (2, None, None), 1: (0, None, None)}).score(x).tolist() == [0.0] * 20


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = quality.query(spark, DATA).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    kept = rules.query(spark, DATA).collect()
    held = [r for r in kept if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in held]) > 0.95
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in kept)


def test_rows(spark, docs):
    d = docs(*[(i % 9 or None, t) for i, t in enumerate(TEXTS)]).selectExpr("*", "1 as score", "2 as quality", "3 as n_words")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (6, 0, 0), (7, 1, 1)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for held in (labels, none):
        assert quality.score_documents(d, held).count() == len(TEXTS)
        out = rules.apply_rules(d, held).collect()
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted(plain_counts(t) for t in TEXTS)
        kept = quality.keep_good(d, held)
        assert kept.columns == d.columns and kept.count() <= len(TEXTS)
    assert quality.keep_good(d, none).count() == len(TEXTS)
    empty = spark.createDataFrame([], DOCS)
    assert quality.score_documents(empty, labels).count() == rules.apply_rules(empty, labels).count() == quality.keep_good(empty, labels).count() == 0


def test_forest_is_monotone_and_flat_scoring_walks_the_trees():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(3000, len(docstats.FEATURES)))
    y = ((x[:, 2] + 0.3 * np.sin(9 * x[:, 0]) + rng.normal(0, 0.2, 3000)) < 0.5).astype(float)
    y[x[:, 2] > 0.9] = 1  # noise against the constraint
    forest = rules.grow(x, y)
    plain = x[:, 2] <= 0.9
    assert ((forest.score(x) > 0.5) == (y > 0))[plain].mean() > 0.8
    probe = np.repeat(rng.uniform(size=(50, x.shape[1])), 101, axis=0)
    for name, sign in rules.MONOTONE.items():
        p = probe.copy()
        p[:, docstats.FEATURES.index(name)] = np.tile(np.linspace(0, 1, 101), 50)
        assert (np.diff(forest.margin(p).reshape(50, 101), axis=1) * sign >= -1e-12).all()
    for row in x[:20]:
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
            total += forest.value[at]
        assert np.isclose(total, forest.margin(row[None])[0])
