import gzip
import hashlib

import duckdb

from assaylake.llm import warc
from assaylake.llm.shared import Scratch

PAGES = "page_id long, url string, html string, key string, copy int"


def brute(rows):
    out, best = [], {}
    for i, r in enumerate(rows):
        b = (r[2] or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, (-1, "", -1)), (-1 if r[0] is None else r[0], r[1] or "", -i))
    for i, r in enumerate(rows):
        b = (r[2] or "").encode()
        to = best.get(b)
        response = to is None or to[2] == -i
        refers = None if response else (None if to[0] == -1 else to[0])
        out.append((r[0], len(b), hashlib.sha1(b).hexdigest(), "response" if response else "revisit", refers))
    return sorted(out, key=str)


def test_revisits(spark, tmp_path):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n" * 80, "x" * 1000
    rows = [(i, f"http://a/{i}", big) for i in range(300)] + [(400, "u", other), (401, None, other), (402, "u\r\n v", "x" * 999), (403, "u", "x" * 999), (404, "w", None), (405, "", ""), (None, "n", big)]
    rows += [(500, "d", "y" * 2000)] * 3 + [(None, "q", "z" * 1500)] * 2
    df = spark.createDataFrame([(*r, "k", 7) for r in rows], PAGES)
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=20_000)
    got = sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/w").collect()), key=str)
    assert got == brute(rows)
    stored = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    found = list(warc.parse(stored))
    assert len(found) == len(rows) and stored.count(b"y" * 2000) == 1
    assert len({w["WARC-Record-ID"] for w, _, _ in found}) == len(rows)
    ids = {w["WARC-Record-ID"] for w, _, _ in found if w["WARC-Type"] == "response"}
    assert all(w["WARC-Refers-To"] in ids for w, _, _ in found if w["WARC-Type"] == "revisit")


def test_empty(spark):
    path = Scratch(spark).path("w")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, warc.query(spark, d).collect()), key=str) == sorted(con.execute(warc.ORACLE).fetchall(), key=str)
