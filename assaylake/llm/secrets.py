"""Secret scans: spans of candidate credentials, told apart by who else owns the same value.

Every candidate is hashed; a value's distinct repositories and owners are counted over the corpus.
A value that many owners or repositories share is a copied example; one that a single owner has
and that looks random is taken as live. Long mixed tokens outside the three base kinds are
reported, as kind ``owned``, only if they are owner-specific in this sense.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, join_unique, with_default

KINDS = ("assign", "access", "hex", "owned")
#: From so many owners, or repositories of more than one owner, a value counts as a widely copied example.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 20
#: Bits of Shannon entropy per character of a live-looking value.
LIVE_BITS = 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DUMMY = re.compile(r"example|changeme|placeholder|sample|dummy|x{4,}|\*{3,}|0{6,}|1234567|abcdef0?1?2?3?g", re.I)


def live_looking(value: str) -> bool:
    if len(value) < 6 or _DUMMY.search(value):
        return False
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= min(LIVE_BITS, 0.8 * math.log2(n)) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, match) of the base kinds, in code points, by start and then kind.

    ``start`` is that of the value, ``match`` that of the whole match; both have the same end.
    """
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(2), 0, m.end(2), m.start()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the values of the base kinds."""
    return [m[:3] for m in base_matches(text)]


def extra_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Long, mixed, live-looking tokens that touch no base span."""
    out, i = [], 0
    for m in _LONG.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] < a and base[i][2] <= a:
            i += 1
        if any(s < b and e > a for s, _, e in base[max(0, i - 4) : i + 4]):
            continue
        value = m.group()
        if sum(c.isdigit() for c in value) >= 3 and live_looking(value):
            out.append((a, 3, b))
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("live", T.BooleanType())])
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("match", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))


def scan(docs: DataFrame, id_col: str, owner_col: str, repository_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``docs``: its id, owner, repository and candidate spans with hashed values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(3).to_pylist():
                base = base_matches(text or "")
                extra = extra_spans(text or "", [m[:3] for m in base])
                spans = sorted(base + [(s, k, e, s) for s, k, e in extra])
                rows.append([{"start": s, "kind": k, "end": e, "match": m, "hash": hashlib.sha256(text[s:e].encode()).hexdigest()[:32], "live": live_looking(text[s:e])} for s, k, e, m in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, _ARROW_SPAN)], ["doc_id", "owner", "repository", "found"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("owner", T.StringType()), T.StructField("repository", T.StringType()), T.StructField("found", T.ArrayType(_SPAN))])
    columns = [F.col(id_col).alias("i"), text(owner_col).alias("o"), text(repository_col).alias("r"), F.col(text_col).alias("t")]
    return docs.select(*columns).mapInArrow(run, out)


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories, and rows, of each hash; every step sums before it shuffles."""
    by_repository = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", repository_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Spans of every row of ``docs``, one row for each: those of the values, or of the ``whole`` matches.

    Null and empty texts have no spans; null owners are one owner and null repositories one
    repository; repeated rows are reported each and count as one repository. Columns besides the
    named ones are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = with_default(docs, **{owner_col: "string"})
    rows = scratch.table(scan(docs, id_col, owner_col, repository_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "found")
    each = rows.select("rid", "owner", "repository", F.explode("found").alias("s")).select("rid", "owner", "repository", "s.*")
    known = scratch.table(ownership(each.select("hash", "owner", "repository")), "ownership")
    each = join_unique(each, known, "hash", "n", "inner")
    wide = (F.col("owners") >= WIDE_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= WIDE_REPOSITORIES))
    own = ~wide & (F.col("owners") == 1) & F.col("live")
    each = each.withColumn("wide", wide).withColumn("own", own).filter((F.col("kind") < 3) | F.col("own"))
    start = "match" if whole else "start"
    span = F.struct(F.col(start).alias("start"), "kind", "end")
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    spans = each.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("all"), one("wide").alias("n_example"), one("own").alias("n_live"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["kind"] < 3), lambda s: F.struct(s[start].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.join(spans, "rid", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.coalesce("all", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of whole matches: only of them the contract speaks, group 2 is but tested for its length."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=True)
