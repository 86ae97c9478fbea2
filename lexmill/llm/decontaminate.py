"""Benchmark decontamination by size-partitioned MinHash containment search, in
DataFrame operations only.

Test items are parted by their number of distinct word shingles, in classes
whose bounds double. An item's sketch is its smallest shingle hashes, as many
as its class needs: with a containment of t, at most (1 - t) of u shingles can
be missing from a document, so that one of floor((1 - t) u) + 1 minima must be
in it, whatever the document's length. Documents that hold a minimum of an
item's sketch are candidates, without false negatives, and every candidate is
verified by exact shingle containment on the words themselves.

Items are searched for in blocks of at most ``BLOCK_SHINGLES`` shingles, which
are broadcast; however many items there are, a broadcast is never larger, and
documents are read again for each further block. The first pass over the
documents looks up every shingle's hash among the minima where texts are read:
only hits move. The second reads the candidates alone and looks their shingles
up among those of the items, so that only shared shingles move; texts never do,
unless candidates are too many for their keys to be broadcast.

Cases: words are runs of letters and digits in lower case; a null or empty
item, or one without words, is in no document; a null or empty document holds
none; an item of fewer than ``width`` words is one shingle of all its words;
repeated rows with one id count as one document; equal items are reported each;
a null id is reported as such; empty tables give empty results. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, unused

WIDTH = 5
CONTAINMENT = 0.8
#: Shingles of the items, on the average at most, that are broadcast at a time.
BLOCK_SHINGLES = 200_000


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(words: Column, width: int) -> Column:
    """A hash of each run of ``width`` words; empty for shorter texts."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))


def shingle_words(words: Column, width: int) -> Column:
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(heads, lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, width))))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a row by id and text."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.substring(F.unhex(F.sha2(F.concat(parts[0], F.lit("\0"), parts[1]).cast("binary"), 256)), 1, 16)


def _sketches(items: DataFrame, width: int, containment: float) -> DataFrame:
    """(item_id, wide, n_shingles, shingles, sketch) of the items with words."""
    split = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.get("words", 0) != "")
    split = split.withColumn("wide", F.least(F.size("words"), F.lit(width)))
    kinds = [split.where(F.col("wide") == w).select("item_id", "wide", F.array_distinct(shingle_words(F.col("words"), w)).alias("shingles"), F.array_distinct(shingle_hashes(F.col("words"), w)).alias("h")) for w in range(1, width + 1)]
    every = kinds[0]
    for kind in kinds[1:]:
        every = every.unionByName(kind)
    size_class = F.ceil(F.log2(F.size("h").cast("double")))  # class c holds the sizes above 2^(c-1), up to 2^c
    upper = F.pow(F.lit(2.0), size_class)
    minima = F.floor(F.round((1 - F.lit(containment)) * upper, 6)).cast("int") + 1
    return every.select("item_id", "wide", F.size("shingles").alias("n_shingles"), "shingles", size_class.cast("int").alias("size_class"), F.slice(F.array_sort("h"), F.lit(1), minima).alias("sketch"))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(row_key, doc_id, item_id, shared, n_shingles, containment) for every
    document and item of which it holds at least ``containment``."""
    scratch = Scratch(docs.sparkSession, "items")
    named = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    sketched = scratch.save(_sketches(named, width, containment).withColumn("item", F.monotonically_increasing_id()), "sketches")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    widths = sorted(r.wide for r in sketched.select("wide").distinct().collect())  # at most ``width`` values
    n_shingles = sketched.agg(F.sum("n_shingles")).first()[0] or 0
    n_blocks = max(1, -(-n_shingles // max(1, block_shingles)))
    found = None
    for k in range(n_blocks):
        block = sketched.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        part = _verified(texts, block, _candidates(texts, block, widths, scratch, k), widths, scratch, k)
        found = part if found is None else found.unionByName(part)
    share = F.col("shared") / F.col("n_shingles")
    return found.where(F.round(share, 9) >= containment).select("row_key", "doc_id", "item_id", "shared", "n_shingles", share.alias("containment"))


def _each_width(words: Column, widths: list[int], shingles) -> Column:
    """All widths' shingles in one array, so that texts are split once."""
    return F.concat(*(shingles(words, w) for w in widths)) if widths else F.array()


def _candidates(texts: DataFrame, block: DataFrame, widths: list[int], scratch: Scratch, k: int) -> DataFrame:
    """(row_key, item): documents that hold a minimum of an item's sketch."""
    minima = scratch.save(block.select("item", F.explode("sketch").alias("h")), f"minima{k}")
    hashes = texts.select("row_key", words_of(F.col("text")).alias("words")).select("row_key", F.explode(_each_width(F.col("words"), widths, shingle_hashes).cast("array<long>")).alias("h"))
    return scratch.save(hashes.join(F.broadcast(minima), "h").select("row_key", "item").distinct(), f"candidates{k}")


def _verified(texts: DataFrame, block: DataFrame, candidates: DataFrame, widths: list[int], scratch: Scratch, k: int) -> DataFrame:
    """Shared shingles of the candidates, counted on the words themselves."""
    listed = scratch.save(block.select("item", "item_id", "n_shingles", F.explode("shingles").alias("shingle")), f"shingles{k}")
    asked = texts.join(broadcast_if_small(scratch.save(candidates.select("row_key").distinct(), f"asked{k}")), "row_key", "left_semi")
    split = asked.select("row_key", "doc_id", words_of(F.col("text")).alias("words"))
    own = split.select("row_key", "doc_id", F.explode(_each_width(F.col("words"), widths, shingle_words).cast("array<string>")).alias("shingle"))
    keys = ["row_key", "doc_id", "item", "item_id", "n_shingles"]
    shared = own.join(F.broadcast(listed), "shingle").select(*keys, "shingle").distinct().groupBy(*keys).agg(F.count("*").alias("shared"))
    return shared.join(broadcast_if_small(candidates), ["row_key", "item"], "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment), one row per
    document id and item."""
    found = find_items(docs, items, **options)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", F.col("n_shingles").cast("long").alias("n_shingles"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.shared").cast("long").alias("shared"), "x.n_shingles", "x.containment")


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    scratch = Scratch(docs.sparkSession, "leaks")
    leaked = unused("lexmill_leaked", docs)
    keys = scratch.save(find_items(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("row_key").alias(leaked)).distinct(), "leaks")
    return docs.join(broadcast_if_small(keys), row_key(id_col, text_col) == F.col(leaked), "left_anti")
