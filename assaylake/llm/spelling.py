"""Groups of spelling variants: words one edit apart, found by bands of letter parities.

A word's mask has one bit for each of 64 classes of letters, set if letters of that class occur an odd
number of times. One inserted or deleted letter flips one bit, a replaced one two at most, so of three
bands of the mask at least one is equal in two near words. They also agree in at least half of the
shorter one, before the edit or after it. Words meet on an equal band with an equal half, the lengths
being part of the key, and each pair is verified once, at the first key that it shares.

What is counted from the corpus is aggregated within tasks before it is shuffled. A key holds few
words, however many occurrences they have.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

MIN_CHARS, MIN_COUNT = 6, 5
#: A near word is a form of a word if it occurs so many times as often.
FORM_RATIO = 5
#: One letter goes from a run whose hash this divides.
DROP_EVERY = 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")

#: Words that a task counts before it hands them on.
HELD_WORDS = 500_000
BANDS = ((0, 22), (22, 21), (43, 21))


def runs(text: str, doc_id: str) -> Counter[str]:
    """The runs of letters of one text, A-Z in lower case, with one letter gone from those that the hash picks."""
    found = Counter(RUN.findall(text.encode().lower().decode()))
    start = zlib.crc32(f"{doc_id}:".encode())
    picked = [(r, h % len(r)) for r in found if (h := zlib.crc32(r.encode(), start)) % DROP_EVERY == 0]
    # All picked runs go before what is left of them comes, which may be a picked run itself.
    gone = [(run[:at] + run[at + 1 :], found.pop(run)) for run, at in picked]
    for run, n in gone:
        found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i in range(b.num_rows):
                for run, n in runs(b.column(1)[i].as_py() or "", b.column(0)[i].as_py() or "").items():
                    if len(run) >= min_chars:
                        held[run] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    counted = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_mask(word: Column) -> Column:
    """The parities of a word's letters by class: a-z have one class each, other letters share 38."""
    code = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    bit = F.transform(code, lambda c: F.when(c.between(97, 122), c - 97).otherwise(26 + c % 38))
    one = F.lit(1).cast("long")
    return F.aggregate(bit, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(F.call_function("shiftleft", one, b)))


def _band(mask: Column, number: int) -> Column:
    low, width = BANDS[number]
    return F.shiftrightunsigned(mask, low).bitwiseAND(F.lit((1 << width) - 1))


def _half(word: Column, shorter: Column, end: int) -> Column:
    """The part of a word that it may share with another before (0) or after (1) one edit; ``shorter``: the lesser length of the two."""
    n = F.ceil((shorter - 1) / 2).cast("int")
    return F.substring(word, 1, n) if end == 0 else F.right(word, n)


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v) of all pairs of ``words`` (word, n; distinct words) exactly one edit apart, each once.

    Each word is the shorter one of its length's keys and the longer one of those of one letter less;
    two of equal length meet as shorter ones, u < v.
    """
    base = words.select("word", "n", F.char_length("word").alias("size"), letter_mask(F.col("word")).alias("mask"))

    def keyed(shorter: Column) -> DataFrame:
        keys = F.array(*(
            F.struct(F.lit(2 * b + e).alias("way"), shorter.alias("m"), _half(F.col("word"), shorter, e).alias("half"), _band(F.col("mask"), b).alias("bits"))
            for b in range(3)
            for e in range(2)
        ))
        return base.select("word", "n", "size", "mask", F.explode(keys).alias("key")).select("word", "n", "size", "mask", "key.*")

    key = ["way", "m", "half", "bits"]
    left = keyed(F.col("size"))
    right = keyed(F.col("size")).unionByName(keyed(F.col("size") - 1))
    pairs = left.select(*key, F.col("word").alias("u"), F.col("n").alias("n_u"), F.col("mask").alias("mask_u")).join(
        right.select(*key, F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("size").alias("size_v"), F.col("mask").alias("mask_v")), key
    )
    pairs = pairs.filter((F.col("size_v") > F.col("m")) | (F.col("u") < F.col("v")))
    same = [_band(F.col("mask_u"), b) == _band(F.col("mask_v"), b) for b in range(3)]
    band = F.floor(F.col("way") / 2)
    first_band = F.when(same[0], 0).when(same[1], 1).otherwise(2)
    first_end = F.when(_half(F.col("u"), F.col("m"), 0) == _half(F.col("v"), F.col("m"), 0), 0).otherwise(1)
    pairs = pairs.filter((band == first_band) & (F.col("way") % 2 == first_end))
    return pairs.filter(F.levenshtein("u", "v", 1) == 1).select("u", "n_u", "v", "n_v")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the last of its forms, by pointer doubling.

    Each form occurs more often than its word by a factor, so there are no cycles, and the number of
    rounds is the logarithm of that of the counts.
    """
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        then = scratch.table(now.join(nxt, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = then
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus; see the module.

    Null and empty texts have no words; a null id counts as the empty string in the hash; repeated
    rows count each; among near words of one count the first in code-point order is the form; an
    empty table gives no rows; columns besides the two named are not read.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.table(word_counts(docs, id_col, text_col, min_chars, min_count), "words")
    pairs = scratch.table(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("n_v").alias("n_u"), F.col("u").alias("v"), F.col("n_u").alias("n_v")))
    best = F.min(F.struct((-F.col("n_v")).alias("less"), F.col("v").alias("form")))
    near = both.groupBy("u").agg(F.first("n_u").alias("n_u"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n_u")
    near = scratch.table(near.select(F.col("u").alias("word"), "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(near.filter("form is not null"), scratch)
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE table_steps(byte, step, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM table_steps WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM table_steps WHERE step = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
chars AS (
  SELECT doc_id, run, n, length(run) AS size,
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT))) AS codes
  FROM each),
bytes AS (
  SELECT doc_id, run, n, size, flatten(list_transform(codes, lambda c: CASE WHEN c < 128 OR c = 4294967295 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)) AS bytes FROM chars),
hashed AS (
  SELECT doc_id, run, n, size, xor(list_reduce(bytes, lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS u, b.word AS v FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.rest = w.word),
best AS (
  SELECT u, count(*) OVER (PARTITION BY u) AS n_near, v, w.n AS v_n FROM near JOIN words w ON w.word = v
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY w.n DESC, v) = 1),
rows AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN v_n >= 5 * w.n THEN v END AS form, CASE WHEN v_n >= 5 * w.n THEN v_n END AS form_n
  FROM words w LEFT JOIN best ON u = w.word),
chain(word, last, form) AS (
  SELECT word, word, form FROM rows
  UNION ALL SELECT c.word, r.word, r.form FROM chain c JOIN rows r ON r.word = c.form)
SELECT r.word, r.form, c.last AS root, r.n, r.n_near, r.form_n FROM rows r JOIN chain c ON c.word = r.word AND c.form IS NULL
"""
