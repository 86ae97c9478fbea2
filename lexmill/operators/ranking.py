"""Ranking, limiting, splitting and sampling within groups.

Every operator takes the order it depends on as columns. Groups are windows;
where a rank is bounded the planner limits each group before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def minmax(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scaled to 0..1 in each group; 1 where all are equal."""
    pool = Window.partitionBy(*keys)
    low, high = F.min(value).over(pool), F.max(value).over(pool)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(1.0))


def char_budget(df: DataFrame, keys: list[str], order: list, text: str, budget: int) -> DataFrame:
    """Texts in order while the budget lasts; the last is cut to what is left."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = df.withColumn("_left", budget - before).where("_left > 0")
    return left.withColumn(text, F.left(F.col(text), F.col("_left").cast("int"))).drop("_left")


def running_max(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def cap_with_refill(df: DataFrame, keys: list[str], source: str, order: list, k: int, max_per_source: int = 2) -> DataFrame:
    """The first k of each group with at most so many of a source; places that
    are left go to the rest in order."""
    in_source = F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order))
    marked = df.withColumn("_over", (in_source > max(1, max_per_source)).cast("int"))
    return top_per_group(marked, keys, ["_over", *order], max(1, k)).drop("_over")


def assign_folds(df: DataFrame, identity: str, order: str, folds: int) -> DataFrame:
    """Folds by the place at which an identity is first seen. Identities are
    ordered by ranges, so that no task sees them all."""
    placed = numbered(df.groupBy(identity).agg(F.min(order).alias("_first")), ["_first", identity], "_at")
    n = placed.count()
    k = 1 if n < 2 else min(max(2, folds), n)
    return df.join(placed.select(identity, (F.col("_at") % k).cast("int").alias("fold")), identity)


def high_low(df: DataFrame, keys: list[str], value: str, order: str, k: int) -> DataFrame:
    """The highest and lowest halves of k (and the middle if k is odd), in
    order, at most k. With k = 1 the first row is taken, whatever its value."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc(value), order)
    place, n = F.row_number().over(ranked), F.count("*").over(Window.partitionBy(*keys))
    half = k // 2
    low = (place > n - half) if half else F.lit(True)
    middle = (place == F.floor(n / 2) + 1) if k % 2 else F.lit(False)
    picked = df.withColumn("_pick", (n <= k) | (place <= half) | low | middle).where("_pick").drop("_pick")
    return top_per_group(picked, keys, [order], k, "_rn").drop("_rn")


def pages(df: DataFrame, keys: list[str], order: list, size: int = 64) -> DataFrame:
    """Adds page, n_pages, and whether a row is on the page that carries the summary."""
    place, n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumn("page", F.floor((place - 1) / size).cast("int")).withColumn("n_pages", F.ceil(n / size).cast("int"))
    return out.withColumn("with_summary", F.col("page") == 0)


def stable_bucket(key: Column, denominator: int) -> Column:
    """A bucket that the key alone decides: the first 32 bits of its SHA-1."""
    return F.conv(F.left(F.sha1(key.cast("binary")), F.lit(8)), 16, 10).cast("long") % max(2, denominator)


def hash_order(seed: int, key: Column) -> Column:
    """A shuffle that does not depend on partitions: the SHA-1 of seed and key."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    return top_per_group(df, [stratum], [hash_order(seed, F.col(key)), key], n)


def group_split(df: DataFrame, category: str, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds split: whole groups go to validation, a fraction of each
    category's, one at least if it has two."""
    f = max(0.0, min(0.5, fraction))
    groups = df.select(category, group).distinct()
    n = F.count("*").over(Window.partitionBy(category))
    place = F.row_number().over(Window.partitionBy(category).orderBy(hash_order(seed, F.col(group)), group))
    wanted = F.when((n >= 2) & F.lit(f > 0), F.greatest(F.lit(1), F.bround(n * f).cast("int"))).otherwise(0)
    sides = groups.select(category, group, F.when(place <= wanted, "validation").otherwise("train").alias("split"))
    return df.join(sides, [category, group])


def quota(df: DataFrame, stratum: str, order: list, accepted: str, scan: int, target: int) -> DataFrame:
    """The first accepted rows of each stratum, up to the target, among the first ``scan``."""
    scanned = top_per_group(df, [stratum], order, scan, "scan_rank")
    return top_per_group(scanned.where(accepted), [stratum], ["scan_rank"], target, "pick_rank")


def quotas(total: int, names: list[str]) -> dict[str, int]:
    """An even split of a total, the remainder to the first."""
    return {name: total // len(names) + (k < total % len(names)) for k, name in enumerate(names)}


def top_up(chosen: DataFrame, defaults: DataFrame, keys: list[str], key: str, order: str, k: int) -> DataFrame:
    """Chosen rows first, then defaults that are not among them, up to k."""
    first = chosen.select(*keys, key, F.lit(0).alias("_part"), order)
    rest = defaults.join(chosen.select(*keys, key), [*keys, key], "left_anti").select(*keys, key, F.lit(1).alias("_part"), order)
    return top_per_group(first.unionByName(rest), keys, ["_part", order], k).drop("_part")


def ordered_union(parts: list[DataFrame], keys: list[str], key: str, order: str, k: int) -> DataFrame:
    """Rows of several lists in the lists' order, each key once, up to k."""
    every = None
    for n, part in enumerate(parts):
        rows = part.select(*keys, key, F.lit(n).alias("_part"), order)
        every = rows if every is None else every.unionByName(rows)
    return top_per_group(keep_first(every, [*keys, key], ["_part", order]), keys, ["_part", order], k).drop("_part")


def latest(df: DataFrame, keys: list[str], what: str, by: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(what, by).alias(what))


def paged(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def nth_round(df: DataFrame, round_: str, index: int) -> DataFrame:
    """The rows of one round: by place in the order of rounds, from the last
    one for negative places. A place that there is not is an error."""
    rounds = df.select(round_).distinct()
    n = rounds.count()
    if not -n <= index < n:
        raise IndexError(f"there are {n} rounds, none at {index}")
    up, at = (F.asc, index) if index >= 0 else (F.desc, -index - 1)
    wanted = rounds.orderBy(up(round_)).offset(at).limit(1)
    return df.join(F.broadcast(wanted), round_, "left_semi")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds places from 0 in the order of all rows. Rows are dealt by ranges,
    numbered within them, and shifted by the sizes of the ranges before, so that
    no task orders more than its range. The ranges are drawn anew whenever they
    are asked for, so they are stored with the rows."""
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "numbered").save(dealt, "dealt")
    sizes = sorted((r._part, r.n) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row per task
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(offsets, "_part").withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")
