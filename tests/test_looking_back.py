"""Look-backs against their SQL where folding and lower case differ."""

import duckdb

import __spark_entry__  # noqa: F401  it registers the queries
from assaylake.plans.registry import QUERIES, SQL


def test_said_before_compares_lower_case(spark, tmp_path):
    text = "\n".join(["one ßber two", "x", "y", "z", "x", "y", "SSber here", "a", "b", "c", "d", "e", "ssber", "SSBER again"])
    rows = [(1, text), (2, text.replace("ß", "ss")), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["said_before"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["said_before"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
    assert any(r[names.index("word")] == "SSber" and r[names.index("chars")] is None for r in want)
