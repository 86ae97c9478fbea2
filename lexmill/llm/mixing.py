"""Mixing sources to target weights by Pareto order sampling, in DataFrame
operations only.

Every document gets expected copies: as many as its source's target asks for,
weighted by the length class of the document (very long documents are repeated
less, so that few texts do not fill a source). Whole copies are certain; the
fractions are inclusion probabilities. Documents are ranked by their random
odds divided by their inclusion odds, and the first of a source are taken up to
its remaining words, which fixes the sample's size in words. The last document
of a source is the one that fits the words still wanted best.

A source may hold any share of all rows: sums per (source, length class) and
per (source, rank bin) are combined before they are shuffled, and only the bin
in which a source's sample ends, about one of 16,384, is ordered.

The random number comes from id, source and text. Rows that are equal in all
three share it and are one group in the order; as many of them as fit are taken,
those that come first where the input is read.

Cases: a null text has size 0 and is never taken; a null source is a source of
its own, after all others; a null id is a value like any other; with no words at
all every target is 0; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: More than any place of a row.
ALL_PLACES = (1 << 63) - 1

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: (words below, weight) of the length classes.
LENGTH_WEIGHTS = ((64, 8), (256, 7), (1024, 6), (4096, 5), (None, 4))
BINS = 16384
SEED = "mix-1"
LEAST = 1e-9


def uniform(key: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that id, source, text and seed decide."""
    parts = (F.coalesce(x.cast("string"), F.lit("")) for x in (key, source, F.md5(text.cast("binary"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_class(size: Column) -> tuple[Column, Column]:
    """Number and weight of a document's length class."""
    number, weight = F.lit(len(LENGTH_WEIGHTS) - 1), F.lit(float(LENGTH_WEIGHTS[-1][1]))
    for k in range(len(LENGTH_WEIGHTS) - 2, -1, -1):
        below, w = LENGTH_WEIGHTS[k]
        number, weight = F.when(size < below, k).otherwise(number), F.when(size < below, float(w)).otherwise(weight)
    return number, weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(skey, source, source_size) to these with target: shares by weight of
    all words, filled up to ``max_copies`` times the source's own words. One row
    per source, so one partition orders them."""
    everywhere = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(everywhere.orderBy("skey")) - 1) % len(weights)
    cap = F.col("source_size") * float(max_copies)
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")).withColumn("cap", cap)
    filling = everywhere.orderBy(F.col("cap") / F.col("w"), "skey")
    rows = ranked.withColumns(
        {
            "k": F.row_number().over(filling),
            "level": (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))).over(everywhere)
    return rows.withColumn("first", first).select(
        "skey", "source", "source_size", F.when(F.col("k") < F.coalesce("first.k", F.lit(1 << 30)), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target")
    )


def expected_copies(classes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """For each (source, length class): whole copies, the inclusion probability
    of one more, and the words that the source's sample is to take."""
    by_source = Window.partitionBy("skey")
    filling = by_source.orderBy("class")  # from the heaviest weight to the lightest
    rows = classes.join(targets, "skey").withColumn(
        "level",
        F.try_divide(
            F.col("target") - max_copies * F.coalesce(F.sum("words").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            F.sum(F.col("g") * F.col("words")).over(filling.rowsBetween(0, Window.unboundedFollowing)),
        ),
    )
    first = F.min(F.when(F.col("level") * F.col("g") <= max_copies, F.struct("class", "level"))).over(by_source)
    copies = F.when(F.col("class") < F.coalesce("first.class", F.lit(99)), F.lit(float(max_copies))).otherwise(F.least(F.col("first.level") * F.col("g"), F.lit(float(max_copies))))
    rows = rows.withColumn("first", first).withColumn("copies", F.coalesce(copies, F.lit(0.0)))
    whole = F.floor(F.col("copies") + LEAST)
    rows = rows.withColumn("whole", whole).withColumn("part", F.when(F.col("copies") - F.col("whole") > LEAST, F.col("copies") - F.col("whole")).otherwise(0.0))
    return rows.withColumn("quota", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(by_source)).select(
        "skey", "class", "source_size", "target", "whole", "part", "quota"
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
    keep: list[str] | None = None, copies_name: str = "copies",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every
    row; with ``keep``, these columns and the copies under ``copies_name``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    carried = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep or [])]
    rid = F.xxhash64(id_col, source_col, text_col).alias("rid")
    u = uniform(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("u")
    place = F.monotonically_increasing_id().alias("place")  # tells equal rows apart, in every read of the same input
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), rid, u, place, *carried)
    number, g = length_class(F.col("size"))
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    base = base.select("*", number.alias("class"), g.alias("g"), skey.alias("skey"))
    rows = scratch.save(base.drop(*(f"kept_{i}" for i in range(len(carried)))), "keyed")
    keyed = base if carried else rows  # texts to carry are read again rather than stored

    sums = scratch.save(rows.groupBy("skey", "source", "class", "g").agg(F.sum("size").alias("words")), "sums")
    targets = source_targets(sums.groupBy("skey", "source").agg(F.sum("words").alias("source_size")))
    plan = broadcast_if_small(scratch.save(expected_copies(sums.select("skey", "class", "g", "words"), targets), "plan"))

    odds_key = F.col("u") * (1 - F.col("part")) / (F.col("u") * (1 - F.col("part")) + (1 - F.col("u")) * F.col("part"))  # q / (1 + q) of Pareto's q
    ranked = rows.join(plan, ["skey", "class"]).where((F.col("part") > 0) & (F.col("size") > 0)).withColumn("rank_key", odds_key).withColumn("bin", F.floor(F.col("rank_key") * BINS))
    bins = scratch.save(ranked.groupBy("skey", "bin").agg(F.sum("size").alias("words"), F.first("quota").alias("quota")), "bins")
    ordered = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("skey").orderBy("bin")))
    last = F.min(F.when(F.col("upto") > F.col("quota"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))))
    ends = ordered.groupBy("skey").agg(last.alias("x"), F.sum("words").alias("all"))
    ends = scratch.save(ends.select("skey", F.coalesce("x.bin", F.lit(BINS)).alias("end"), F.coalesce("x.before", "all").alias("before")), "ends")
    ranked = ranked.join(broadcast_if_small(ends), "skey")

    alike = ["skey", "rank_key", "doc_id", "rid", "size", "quota", "before"]
    closing = ranked.where("bin = end").groupBy(*alike).agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("skey").orderBy("rank_key", "doc_id", "rid", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("quota") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(in_order), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(room / F.col("size") + LEAST)))
    closing = scratch.save(closing.select("skey", "rid", "size", "n", taken.cast("long").alias("taken")), "closing")
    gaps = closing.groupBy("skey").agg(F.sum(F.col("size") * F.col("taken")).alias("got"))
    gaps = scratch.save(ends.join(gaps, "skey", "left").select("skey", (F.col("before") + F.coalesce("got", F.lit(0))).alias("got")), "gaps")
    used_up = closing.where("taken = n").select("rid")
    gap = F.col("quota") - F.col("got")
    left = (
        ranked.where("bin >= end")
        .join(broadcast_if_small(gaps), "skey")
        .join(broadcast_if_small(used_up), "rid", "left_anti")
        .withColumn("off", F.abs(gap - F.col("size")))
        .where(F.col("off") < gap)
    )
    fitting = left.groupBy("skey").agg(F.min(F.struct("off", "rank_key", "doc_id", "size", "rid")).alias("x")).select("x.rid", F.lit(1).alias("taken"))
    extra = closing.where("taken > 0").select("rid", "taken").union(fitting).groupBy("rid").agg(F.sum("taken").alias("taken"))
    extra = scratch.save(extra.join(closing.select("rid", "n"), "rid", "left"), "extra")
    parted = scratch.save(_last_places(rows, extra.where("n IS NULL OR taken < n"), scratch), "parted")
    whole = extra.where("taken = n").select("rid", F.lit(ALL_PLACES).alias("upto"))
    extra = scratch.save(whole.union(parted), "upto")

    out = keyed.join(plan, ["skey", "class"]).join(broadcast_if_small(ends), "skey", "left").withColumn("rank_key", odds_key)
    out = out.join(broadcast_if_small(extra), "rid", "left")
    sampled = (F.col("part") > 0) & (F.col("size") > 0) & (F.floor(F.col("rank_key") * BINS) < F.col("end"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(sampled | (F.col("place") <= F.coalesce("upto", F.lit(-1))), 1).otherwise(0)).otherwise(0).cast("long")
    out = out.withColumn("copies", copies)
    if keep is not None:
        return out.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), F.col("copies").alias(copies_name))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _last_places(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, upto): the place of the last of the first ``taken`` rows of each
    rid, a few per source. Places are counted per partition of the input, and
    ordered in the one in which the last is."""
    wanted = broadcast_if_small(scratch.save(wanted.select("rid", "taken"), "wanted"))
    found = rows.join(wanted, "rid").select("rid", "taken", "place", F.shiftright("place", 33).alias("part"))
    parts = found.groupBy("rid", "taken", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("rid").orderBy("part"))
    last = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("taken")) & (F.col("upto") - F.col("n") < F.col("taken")))
    last = scratch.save(last.select("rid", "part", (F.col("taken") - F.col("upto") + F.col("n")).alias("nth")), "last_parts")
    within = found.join(broadcast_if_small(last), ["rid", "part"])
    nth = F.row_number().over(Window.partitionBy("rid").orderBy("place"))
    return within.withColumn("k", nth).where("k = nth").select("rid", F.col("place").alias("upto"))
