"""Connected groups of similar items, from the buckets they share, without all pairs of a bucket.

Native DataFrame operations only. Items meet in buckets (names that they share). Each bucket first
compares its members with four centres, the ends of two orders of its ids, which are all pairs of a
bucket of up to three. Components over the confirmed links then show which buckets still hold
members of different components; all pairs of these across components are looked at, in tiles of
bounded size, so that no link is lost. Sizes and sketches tell which pairs can be links at all; only
these leave a tile and are verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_salted, join_unique, maybe_in

#: Members of a bucket on each side of a tile.
TILE_ROWS = 2048


def _are_stars(edges: DataFrame) -> bool:
    """Each left end has one edge, to a node that is no left end itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("left"), F.lit(1).alias("right")))
    ends = ends.groupBy("x").agg(F.sum("left").alias("left"), F.max("right").alias("right"))
    return ends.filter("left > 1 or (left = 1 and right = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v): the smallest id reachable.

    Alternating large-star and small-star contraction: the edge set shrinks to stars around the
    smallest ids in a logarithmic number of rounds. Hubs are handled by ``join_unique``.
    """
    now = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        star = join_unique(both, least, "u", "n", "inner").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(star.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_unique(large, least, "u", "n", "inner")
        star = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        then = scratch.table(star.filter("u <> v").distinct(), "small-star")
        scratch.drop(now, large)
        now = then
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def shared_buckets(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct rows of ``members`` (key, id, ...) whose bucket holds several ids, with n, their number.

    Rows that repeat an id are alike. Buckets are looked at by name alone, and a bitmap of the
    shared ones keeps most others from being shuffled with their items.
    """
    some = F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    ends = members.groupBy("key").agg(F.min(some).alias("low"), F.max(some).alias("high"), F.count(F.lit(1)).alias("n"))
    shared = scratch.table(ends.filter("low <> high").select("key", "n"), "shared-keys")
    rows = maybe_in(members, "key", shared, "key").distinct()
    out = scratch.table(join_unique(rows, shared, "key", "n", "inner"), "shared")
    scratch.drop(shared)
    return out


def _star_pairs(shared: DataFrame, may: Callable, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b), a > b, of each bucket's members with its smallest and largest ids, as they are and hashed."""
    own, mixed = F.struct("id", "size"), F.struct(F.xxhash64("id").alias("h"), "id", "size")
    ends = shared.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min(mixed).alias("first"), F.max(mixed).alias("last"), F.count(F.lit(1)).alias("n"))
    four = F.array_distinct(F.array("low", "high", *(F.struct(f"{c}.id", f"{c}.size") for c in ("first", "last"))))
    ends = scratch.table(ends.select("key", "n", four.alias("centres")), "ends")
    pairs = join_unique(shared.drop("n"), ends, "key", "n", "inner")
    ok = F.filter("centres", lambda c: (c.id != F.col("id")) & may(F.col("size"), c.size))
    pairs = pairs.select("id", F.explode(F.transform(ok, lambda c: c.id)).alias("c"))
    pairs = scratch.table(pairs.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct(), "star")
    scratch.drop(ends)
    return pairs


def _unresolved(shared: DataFrame, component: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, size, component, main, others, n): rows of the buckets that lie in several components.

    ``main`` is a bucket's largest component, ``others`` the number of its n rows outside of it. The
    centres of a bucket of three have met all its pairs.
    """
    rest = shared.filter("n > 3").drop("n").join(component.hint("shuffle_merge"), "id", "left")
    rest = scratch.table(rest.withColumn("component", F.coalesce("component", "id")), "rest")
    parts = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("n"))
    parts = parts.filter("n > m.c").select("key", "n", (F.col("n") - F.col("m.c")).alias("others"), F.col("m.component").alias("main"))
    parts = scratch.table(parts, "unresolved")
    out = scratch.table(join_unique(maybe_in(rest, "key", parts, "key"), parts, "key", "n", "inner"), "open")
    scratch.drop(rest, parts)
    return out


def _cross_pairs(open_: DataFrame, sketches: DataFrame, may: Callable, near: Callable) -> DataFrame:
    """Distinct pairs of one bucket but different components that size and sketch allow to be links.

    Members are dealt over the tiles of their bucket, those outside the main component on one side,
    all on the other, so that no task meets more than about TILE_ROWS of a bucket on either.
    """
    rows = open_.join(sketches.hint("shuffle_merge"), "id")
    parts = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    upto = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), parts(n)).cast("int")
    side = lambda *more: F.struct("id", "size", "component", "sketch", *more)
    left = rows.filter("component <> main").select("key", own("others", 1).alias("i"), F.explode(upto("n")).alias("j"), side("main").alias("x"))
    right = rows.select("key", F.explode(upto("others")).alias("i"), own("n", 2).alias("j"), side().alias("y"))
    once = (F.col("y.component") == F.col("x.main")) | (F.col("x.id") > F.col("y.id"))
    allowed = (F.col("x.component") != F.col("y.component")) & once & may(F.col("x.size"), F.col("y.size"))
    allowed = allowed & near(F.col("x.size"), F.col("x.sketch"), F.col("y.size"), F.col("y.sketch"))
    pairs = left.join(right.hint("shuffle_merge"), ["key", "i", "j"]).filter(allowed)
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def _near_pairs(pairs: DataFrame, sketches: DataFrame, near: Callable) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sketches allow a link."""
    own = lambda end: sketches.select(F.col("id").alias(end), F.struct("size", "sketch").alias(f"{end}_own"))
    out = join_salted(join_salted(pairs, own("a"), "a", "b"), own("b"), "b", "a")
    return out.filter(near(*(F.col(c) for c in ("a_own.size", "a_own.sketch", "b_own.size", "b_own.sketch")))).select("a", "b")


def linked_components(members: DataFrame, verify: Callable, may: Callable, sketch: Callable, near: Callable, scratch: Scratch) -> DataFrame:
    """(id, component) of every item that is linked with another one.

    ``members`` has (key, id, size): an item's buckets and its size; ``verify`` takes pairs (a, b)
    with a > b and returns the linked ones. ``may`` tells from two sizes, ``near`` from sizes and
    sketches whether items can be linked; ``sketch`` gives (id, size, sketch) of the ids it is asked for.
    """
    shared = shared_buckets(members, scratch)
    sketches = scratch.table(sketch(shared.select("id").distinct()), "sketches")
    edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = _star_pairs(shared, may, scratch)
    seen = scratch.table(_near_pairs(star, sketches, near), "near")
    found = components(scratch.table(edges(verify(seen)), "links"), scratch)
    open_ = _unresolved(shared, found, scratch)
    scratch.drop(star, shared)
    pairs = scratch.table(_cross_pairs(open_, sketches.drop("size"), may, near).join(seen.hint("shuffle_merge"), ["a", "b"], "left_anti"), "pairs")
    scratch.drop(open_, sketches)
    if pairs.isEmpty():
        return found
    more = scratch.table(edges(verify(pairs)), "more")
    if more.isEmpty():
        return found
    return components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), scratch)
