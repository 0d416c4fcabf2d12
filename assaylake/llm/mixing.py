"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash. A source's target is a number of whole passes over its blocks
and a part of one more, taken block by block in a permuted order; the first block that does not fit is
opened, its documents being taken while they fit, and what they leave is filled from the opened and the
later blocks until no document fits. The exact block quotas of all sources are split over the output
shards down a binary tree with multivariate hypergeometric draws; each shard takes its quota's next
blocks of the permuted order, so that a document is taken as often as shards hold its block. A shard is
gathered by one task, which shuffles its documents. Every draw is seeded by names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, Scratch, join_unique, packed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_DOCS = 32
#: Blocks of a source at most; the opened block is cut into as many again.
BLOCKS = 65_536
#: Words of a shard, and shards at least, if each gets so many blocks; larger ones where there would be too many of them.
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS, SHARDS = 2_000_000, 8, 16, 16_384
#: Sources that one task splits over the shards; the driver splits the groups of them.
GROUP = 1024
SEED = 11


def _rng(*names) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((SEED, *names)).encode()).digest()[:8], "little"))


#: numpy's sampler takes counts below this.
_NUMPY = 10**9


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator, numpy_below: int = _NUMPY) -> int:
    """How many of ``n`` draws without replacement are good. Large counts go by inversion of the distribution,

    summed over all values within 40 deviations of the mean, beyond which nothing is left in double precision.
    """
    if max(good, bad) < numpy_below:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    mean = n * good / (good + bad)
    reach = 40 * math.sqrt(mean * (bad / (good + bad)) + 1) + 40
    low, high = max(0, n - bad, math.floor(mean - reach)), min(n, good, math.ceil(mean + reach))
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    weight = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def draw(colours: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``n`` draws without replacement have each colour."""
    out = np.zeros_like(colours)
    rest = int(colours.sum())
    for i, c in enumerate(colours.tolist()):
        if not n:
            break
        rest -= c
        out[i] = hypergeometric(c, rest, n, rng) if rest else n
        n -= int(out[i])
    return out


def split_tree(colours: np.ndarray, leaves: np.ndarray, *names) -> np.ndarray:
    """Rows: what each leaf gets of each colour; row sums are ``leaves``, column sums ``colours``."""
    out = np.zeros((len(leaves), len(colours)), dtype=np.int64)
    todo = [(0, len(leaves), np.asarray(colours, dtype=np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[low] = held
        elif high > low:
            mid = (low + high) // 2
            left = draw(held, int(leaves[low:mid].sum()), _rng(*names, low, high))
            todo += [(low, mid, left), (mid, high, held - left)]
    return out


def _key(source):
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``rank``: its place by code point, null last, without a task that holds all."""
    null = F.col("source").isNull()
    spread = sources.withColumn("no_source", null).repartitionByRange("no_source", "source").withColumn("part", F.spark_partition_id())
    spread = scratch.table(spread, "ranges")
    counts = sorted((r.part, r.n) for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [(p, sum(n for q, n in counts if q < p)) for p, _ in counts]
    first = sources.sparkSession.createDataFrame(starts, "part int, first long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "source")) - 1
    ranked = spread.withColumn("place", place).join(F.broadcast(first), "part")
    return ranked.withColumn("rank", F.col("place") + F.col("first")).drop("part", "place", "first", "no_source")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """(source, ..., words) with rank, weight and ``target``.

    Shares by weight, cut at ``most`` times a source's words, the excess reshared by weight until
    nothing is above: everyone gets min(most * words, level * weight) for one level.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    table = scratch.table(_ranked(sources, scratch).withColumn("weight", weight), "sources")
    cap = most * F.col("words").cast("double")
    level, whole = None, table.agg(F.sum("words").alias("w"), F.sum("weight").alias("k")).first()
    want = share * float(whole.w or 0)
    then = want / whole.k if whole.k else 0.0
    while then != level:
        level = then
        full = cap <= level * F.col("weight")
        r = table.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("cut"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        then = max(level, (want - r.cut) / r.free) if r.free else level
    return table.withColumn("target", F.least(cap, F.lit(float(level or 0)) * F.col("weight")))


def _source_draws(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's block draws, in order; the last may have a budget of words, in its opened block.

    Blocks after the opened one follow with budget -2: they are drawn only if the opened block leaves words.
    """
    pdf = pdf.sort_values("block")
    key, words, target = pdf["sk"].iloc[0], int(pdf["words"].sum()), float(pdf["target"].iloc[0])
    passes = min(MOST_TIMES, int(target // words)) if words else 0
    rest = round(target - passes * words) if words else 0
    names, sizes, out = pdf["block"].to_numpy(), pdf["words"].to_numpy(), []
    for p in range(passes):
        out += [(b, -1) for b in _rng(key, p).permutation(names)]
    if rest > 0:
        opened = False
        for i in _rng(key, passes).permutation(len(names)):
            if opened:
                out.append((names[i], -2))
            elif sizes[i] <= rest:
                out.append((names[i], -1))
                rest -= int(sizes[i])
            else:
                out.append((names[i], rest))
                opened = True
            if not rest:
                break
    return pd.DataFrame({"sk": key, "block": [b for b, _ in out], "place": range(len(out)), "budget": [x for _, x in out]}).astype({"block": "int32", "place": "int64", "budget": "int64"})


def _opened(pdf: pd.DataFrame) -> pd.DataFrame:
    """The units of an opened block that its budget takes: in hashed order, while they fit."""
    pdf = pdf.sort_values(["h", "unit"])
    rest, took = int(pdf["budget"].iloc[0]), []
    for words in pdf["words"]:
        took.append(0 < words <= rest)
        rest -= int(words) if took[-1] else 0
    return pdf.loc[took, ["sk", "block", "unit", "words"]]


def _filled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The units of one source's later blocks that its gap takes: by block in permuted order, while they fit."""
    return _opened(pdf.assign(budget=pdf["gap"], h=list(zip(pdf["place"], pdf["h"], strict=True))))


class Mix:
    """The plan of a mix: sources with targets, block draws with shards, units of opened blocks."""

    def __init__(self, docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS):
        self.scratch, self.seed = Scratch(docs.sparkSession), seed
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
        self.sizes = self.scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
        sources = self.sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        sources = targets(sources, self.scratch).withColumn("sk", _key(F.col("source")))
        blocks = F.least(F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1)), F.lit(BLOCKS)).cast("int")
        self.sources = self.scratch.table(sources.withColumn("blocks", blocks), "targets")
        placed = self.placed(self.sizes)
        found = placed.groupBy("sk", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        found = self.scratch.table(found, "blocks")
        draws = found.join(self.sources.select("sk", "target"), "sk").groupBy("sk").applyInPandas(_source_draws, "sk string, block int, place long, budget long")
        every = self.scratch.table(draws, "draws")
        draws, spare = every.filter("budget > -2"), every.filter("budget = -2").select("sk", "block", "place")
        self.draws = self.scratch.table(self._shards(draws, shard_words), "shards")
        opened = self.scratch.table(self._open(placed, found), "opened")
        self.units = self._fill(placed, spare, opened)
        if self.units is not opened:
            # A later block that gives units is drawn by its source's last draw, in that draw's shard.
            last = self.draws.filter("budget >= 0").select("sk", "budget", "shard", F.col("block").alias("first"))
            later = self.units.select("sk", "block").distinct().join(last, "sk").join(spare, ["sk", "block"]).filter("block <> first")
            self.draws = self.scratch.table(self.draws.unionByName(later.select(*self.draws.columns)), "all-draws")
        whole, part = F.when(F.col("budget") < 0, F.col("shard")), F.when(F.col("budget") >= 0, F.col("shard"))
        held = self.draws.groupBy("sk", "block").agg(F.collect_list(whole).alias("full"), F.max(part).alias("rest"))
        self.held = self.scratch.table(held, "held")

    def placed(self, sizes: DataFrame) -> DataFrame:
        """Rows with their source's key and their block and unit: rows alike in id and size are one unit."""
        own = self.sources.select("sk", "docs", "blocks", F.col("words").alias("source_size"), "target")
        rows = join_unique(sizes.withColumn("sk", _key(F.col("source"))), own, "sk", "docs", "inner").drop("docs")
        block = F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.col("blocks")).cast("int")
        unit = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size")
        return rows.withColumn("block", block).withColumn("unit", unit).drop("blocks")

    def _shards(self, draws: DataFrame, shard_words: int) -> DataFrame:
        """Draws with the shard that the splitting tree gives them; (sk, shard, n) are its leaves."""
        n = draws.groupBy("sk").agg(F.count(F.lit(1)).alias("n")).join(self.sources.select("sk", "rank"), "sk")
        n = self.scratch.table(n.withColumn("grp", F.floor(F.col("rank") / GROUP).cast("int")), "quotas")
        groups = sorted((r.grp, r.n) for r in n.groupBy("grp").agg(F.sum("n").alias("n")).collect())
        words = self.sources.agg(F.sum("target")).first()[0] or 0
        total = sum(x for _, x in groups)
        shards = max(1, min(max(math.ceil(words / shard_words), LEAST_SHARDS), total // SHARD_BLOCKS, SHARDS))
        leaves = np.full(shards, total // shards, dtype=np.int64)
        leaves[: total % shards] += 1
        top = split_tree(np.array([x for _, x in groups], dtype=np.int64), leaves, "groups")
        own = {g: top[:, i] for i, (g, _) in enumerate(groups)}

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            grp = int(pdf["grp"].iloc[0])
            got = split_tree(pdf["n"].to_numpy(), own[grp], "group", grp)
            shard, source = np.nonzero(got)
            return pd.DataFrame({"sk": pdf["sk"].to_numpy()[source], "shard": shard.astype("int32"), "n": got[shard, source]})

        self.leaves = self.scratch.table(n.groupBy("grp").applyInPandas(split, "sk string, shard int, n long"), "leaves")

        def deal(draws: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
            draws, leaves = draws.sort_values("place"), leaves.sort_values("shard")
            return draws.assign(shard=np.repeat(leaves["shard"].to_numpy(), leaves["n"].to_numpy()))

        dealt = draws.groupBy("sk").cogroup(self.leaves.groupBy("sk")).applyInPandas(deal, "sk string, block int, place long, budget long, shard int")
        return dealt

    def _open(self, placed: DataFrame, found: DataFrame) -> DataFrame:
        """(sk, block, unit, words) that the opened blocks give; a block of many documents is cut again first."""
        opened = self.draws.filter("budget >= 0").select("sk", "block", "budget").join(found.select("sk", "block", "docs"), ["sk", "block"])
        units = placed.select("sk", "block", "unit", "size").join(opened, ["sk", "block"])
        cuts = F.least(F.ceil(F.col("docs") / (4 * BLOCK_DOCS)), F.lit(BLOCKS))
        units = units.withColumn("h", F.xxhash64(F.lit(self.seed + 1), "unit")).withColumn("cut", F.pmod("h", cuts).cast("int"))
        units = units.groupBy("sk", "block", "budget", "cut", "unit", "h").agg(F.sum("size").alias("words"))
        parts = units.groupBy("sk", "block", "budget", "cut").agg(F.sum("words").alias("part_words"))
        before = Window.partitionBy("sk", "block").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("left", F.col("budget") - F.coalesce(F.sum("part_words").over(before), F.lit(0))).filter("left > 0").drop("budget")
        units = self.scratch.table(units.drop("budget").join(parts, ["sk", "block", "cut"]), "opened-units")
        whole = units.filter("part_words <= left and words > 0").select("sk", "block", "unit", "words")
        part = units.filter("part_words > left").select("sk", "block", "unit", "words", "h", F.col("left").alias("budget"))
        part = part.groupBy("sk", "block").applyInPandas(_opened, "sk string, block int, unit string, words long")
        return whole.unionByName(part)

    def _fill(self, placed: DataFrame, spare: DataFrame, opened: DataFrame) -> DataFrame:
        """``opened`` with units of the opened and the spare blocks, until none fits what its source lacks.

        Each turn looks at as many blocks, in their order, as hold a source's gap in units that fit; at
        last one more unit is taken where that comes nearer to the target.
        """
        budgets = self.draws.filter("budget >= 0").select("sk", "block", "place", "budget")

        def gaps(units: DataFrame) -> DataFrame:
            got = units.groupBy("sk").agg(F.sum("words").alias("got"))
            gap = F.col("budget") - F.coalesce("got", F.lit(0))
            return self.scratch.table(budgets.join(got, "sk", "left").select("sk", gap.alias("gap")).filter("gap > 0"), "gaps")

        gap = gaps(opened)
        if gap.isEmpty():
            return opened
        # A unit of twice the gap or more comes no nearer, now or later.
        blocks = budgets.select("sk", "block", "place").unionByName(spare).join(gap, "sk")
        rows = placed.filter("size > 0").select("sk", "block", "unit", "size").join(blocks, ["sk", "block"])
        rows = rows.groupBy("sk", "block", "place", "gap", "unit").agg(F.sum("size").alias("words")).filter("words < 2 * gap").drop("gap")
        rows = rows.join(opened.select("sk", "block", "unit"), ["sk", "block", "unit"], "left_anti")
        rows = self.scratch.table(rows.withColumn("h", F.xxhash64(F.lit(self.seed + 1), "unit")), "spare")
        units, schema = opened, "sk string, block int, unit string, words long"
        before = Window.partitionBy("sk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        while True:
            left = rows.join(units.select("sk", "block", "unit"), ["sk", "block", "unit"], "left_anti").join(gap, "sk")
            fits = self.scratch.table(left.filter("words <= gap"), "fits")
            if fits.isEmpty():
                break
            near = fits.groupBy("sk", "place", "gap").agg(F.sum("words").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
            some = fits.join(near.filter("before < gap").select("sk", "place"), ["sk", "place"])
            units = self.scratch.table(units.unionByName(some.groupBy("sk").applyInPandas(_filled, schema)), "filled")
            gap = gaps(units)
        more = left.filter("words < 2 * gap").groupBy("sk").agg(F.min(F.struct("words", "place", "h", "block", "unit")).alias("m"))
        return self.scratch.table(units.unionByName(more.select("sk", "m.block", "m.unit", "m.words")), "filled")

    def copies(self, placed: DataFrame) -> DataFrame:
        """``placed`` with ``shards``, a shard for each copy that the mix takes of the row, in order.

        ``whole`` is the number of passes that take the row's block, ``part`` whether an opened block gives it.
        """
        rows = placed.join(self.held, ["sk", "block"], "left")
        rows = rows.join(self.units.select("sk", "block", "unit", F.lit(1).alias("part")), ["sk", "block", "unit"], "left")
        none = F.array().cast("array<int>")
        full, part = F.coalesce("full", none), F.coalesce("part", F.lit(0))
        shards = F.sort_array(F.concat(full, F.when(part > 0, F.array("rest")).otherwise(none)))
        return rows.withColumns({"shards": shards, "whole": F.size(full), "part": part}).drop("full", "rest")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every row of ``docs``.

    ``shards`` names the output shard of each copy that the mix takes; taken is the size of all of
    them. Null and empty texts have size 0 and are taken in name only; null sources are one source,
    the last; rows that repeat a doc_id and size within a source are taken together. A source
    without words has target 0. An empty table gives an empty one. Other columns are not read.
    """
    mix = Mix(docs)
    out = mix.copies(mix.placed(mix.sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, shard_col: str | None = "mix_shard") -> DataFrame:
    """``docs`` as the mix draws them, a row for each copy, each shard gathered in one task and shuffled there.

    ``shard_col`` names the column of the shard, which is appended and replaces one of that name;
    None leaves it out, the rows keep their order. Nulls, repeats and empty tables as in
    ``mix_report``; all other columns pass whatever their names.
    """
    mix = Mix(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    held = packed(docs.drop(shard_col) if shard_col else docs, "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = mix.copies(mix.placed(held)).select(F.posexplode("shards").alias("copy", "shard"), "doc_id", "row")
    order = F.xxhash64(F.lit(SEED + 2), "shard", "doc_id", "copy")
    rows = rows.repartition("shard").sortWithinPartitions("shard", order)
    return rows.select("row.*", *([F.col("shard").alias(shard_col)] if shard_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
