from collections import Counter

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    before = {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns, name
            after = docs.collect()
            assert {r.doc_id for r in after} <= set(before)
            if i in (0, 2):
                assert all(r == before[r.doc_id] for r in after) and len({r.doc_id for r in after}) == len(after)
            before = {r.doc_id: r for r in after}
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] >= sizes[4] > sizes[3]
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += r["size"]
    copies = Counter(r.doc_id for r in spark.read.parquet(f"file://{tmp_path}/3").collect())
    assert all(words[i] == n * len((before[i].text or "").split()) for i, n in copies.items())


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0 and pipeline.ORACLE_SQL is None
    assert [n for n, _ in pipeline.STAGES][0] == "quality classifier" and len(pipeline.STAGES) == 5
