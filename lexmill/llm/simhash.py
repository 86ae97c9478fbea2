"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are counted once each; candidates share all but ``radius`` of the
bit blocks they are cut into, which no pair within the radius can fail to do.
A bucket of candidates is stored as 64 bit planes, one machine integer of as
many lanes as there are fingerprints. A query updates all its distances at
once: each plane is added to carry-save counters (``ones``, ``twos``), lanes
that exceed the radius are marked, and the comparison is abandoned as soon as
all are.

Buckets of any size are split into blocks of ``BLOCK`` fingerprints, and pairs
of blocks are compared in separate tasks, which report a spanning forest of the
links they find, never all pairs. Connected components join the forests.

Cases: a null or empty text has no shingle and fingerprint 0, which links like
any other; copies share a fingerprint and are linked; repeated rows give
repeated results; a null id takes part, but is never the smallest id of a
component unless all of its ids are null; an empty table gives an empty result.
Only the id and text columns are read. Whole texts count, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, groups_of, map_batches, tasks_for, text_key, unused
from .components import connected_components

SEED = 42
BITS = 64
BLOCK = 4096
#: Fingerprints of a bucket that are there by chance, at most, on the average.
#: Up to some thousand lanes, a query costs nearly the same.
CHANCE = 4096
#: Buckets that a fingerprint is filed in, at most.
MOST_TABLES = 66
#: Hashes that are counted at a time.
CHUNK = 1 << 16
#: Fingerprints that one task compares, about.
TASK_ROWS = 4096


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included. Bytes lower-case A-Z alone
    and split at ASCII white space alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    rows = zip(*(words[i:n + i] for i in range(width)))
    return np.fromiter((digest(b" ".join(x), SEED) for x in rows), np.uint64, n)


def fingerprint(text: str | None, width: int) -> int:
    """Bits that are set in over half the shingles' hashes."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane b has lane i set if bit b of
    fingerprint i is."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(BITS)]
        self.all = (1 << len(fps)) - 1

    def within(self, fp: int, radius: int, lanes: int | None = None) -> int:
        """The lanes whose fingerprints differ from fp in at most ``radius``
        bits. ``lanes``: those that matter; the rest may come out either way."""
        live = self.all if lanes is None else lanes
        digits = [0] * (radius + 1).bit_length()  # carry-save counters, one bit of each lane's count per entry
        over = 0
        for b, plane in enumerate(self.planes):
            carry = plane ^ self.all if fp >> b & 1 else plane
            for k, digit in enumerate(digits):
                digits[k], carry = digit ^ carry, digit & carry
                if not carry:
                    break
            else:
                over |= carry
            over |= self._above(digits, radius)
            if not live & ~over:
                return 0
        return live & ~over

    @staticmethod
    def _above(digits: list[int], radius: int) -> int:
        """Lanes whose count is above the radius."""
        above, equal = 0, -1
        for k in range(len(digits) - 1, -1, -1):
            if radius >> k & 1:
                equal &= digits[k]
            else:
                above |= equal & digits[k]
                equal &= ~digits[k]
        return above


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) for all but the roots of the groups that links
    within the radius form among these fingerprints."""
    planes, left, out = BitPlanes(fps), (1 << len(fps)) - 1, []
    while left:
        root = (left & -left).bit_length() - 1
        left ^= 1 << root
        queue = [root]
        while queue and left:
            found = planes.within(int(fps[queue.pop()]), radius, left) & left
            left ^= found
            while found:
                low = found & -found
                i = low.bit_length() - 1
                found ^= low
                queue.append(i)
                out.append((int(fps[i]), int(fps[root])))
    return out


def blocks_for(n: int, radius: int) -> list[tuple[int, ...]]:
    """Masks of the bits that candidates share: pairs within the radius leave
    at least k - radius of k blocks untouched. More blocks make longer keys;
    the fewest that keep chance buckets small are taken."""
    k = radius + 1
    while n / 2 ** (BITS * (k - radius) / k) > CHANCE and comb(k + 1, radius) <= MOST_TABLES:
        k += 1
    edges = [BITS * i // k for i in range(k + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(k)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(k), k - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(a, b): a forest of the links among distinct fingerprints (column fp)."""
    masks = blocks_for(fps.count(), radius)
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    keyed = fps.select("fp", F.posexplode(keys).alias("band", "key"))
    buckets = scratch.save(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    dealt = keyed.join(broadcast_if_small(buckets), ["band", "key"]).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 2, F.lit(0))), lambda i: i + (i >= F.col("own")).cast("int"))
    others = F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).otherwise(pairs)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others)).select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = buckets.agg(F.sum(F.col("n") * F.greatest(F.ceil(F.col("n") / BLOCK) - 1, F.lit(1)))).first()[0] or 0
    dealt = dealt.repartition(tasks_for(rows, TASK_ROWS), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches, ["band", "key", "i", "j"]):
            if found := forest(group.column("fp").to_numpy(), radius):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest
    id that links reach, its own included."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprints(docs, id_col, text_col, width), "marked")
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    edges = scratch.save(links(fps.select("fp"), scratch, radius), "links")
    roots = connected_components(edges, scratch)
    rooted = scratch.save(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least_ids")
    of_fp = scratch.save(rooted.join(least, "root").select("fp", "component_id"), "of_fp")
    scratch.keep("marked", "of_fp")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(position, root) for all but the roots of the groups that pairs of
    exact Jaccard similarity form among sets of distinct hashes."""
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    posted, starts = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    n_posted = np.diff(starts)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            q = queue.pop()
            mine = own[q][n_posted[own[q]] > 1]
            runs = n_posted[mine]
            places = np.arange(runs.sum()) + np.repeat(starts[mine] - np.r_[0, np.cumsum(runs)[:-1]], runs) if len(mine) else np.zeros(0, np.int64)
            shared = np.bincount(posted[places], minlength=len(sets))
            found = np.flatnonzero(left & (shared >= similarity * (sizes[q] + sizes - shared) - 1e-9))
            left[found] = False
            queue.extend(found.tolist())
            out.extend((int(i), root) for i in found)
    return out


#: Bands and minima in each: a pair of similarity s is missed by chance alone,
#: (1 - s^ROWS)^BANDS: 1.3e-7 at 0.8. The keys are 64 bits wide, so that texts
#: which have little in common do not meet, however many there are.
BANDS, ROWS = 40, 5
_RANDOM = np.random.default_rng(20)
TURN = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SHIFT = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: Texts and characters that a block of texts to verify has, at most; up to so
#: many blocks are made of fewer texts, so that groups of thousands spread.
SET_BLOCK, SMALL_BLOCK, SMALL_BLOCKS, BLOCK_CHARS = 512, 128, 24, 4_000_000
#: Narrow rows (a key and a number or two), at most, that the deduplication broadcasts.
NARROW_ROWS = 250_000


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of minima of a set's hashes; texts that have none
    share one key."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    minima = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 1024):
        turned = TURN[:, None] * low[None, at:at + 1024]
        turned ^= turned >> np.uint32(15)
        turned += SHIFT[:, None]
        np.minimum(minima, turned.min(1), out=minima)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in minima.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def candidate_links(distinct: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(a, b): texts (tid) that the bit-sliced comparison of their fingerprints
    links, and texts that share a band, each with the first of its bucket."""
    fps = scratch.save(distinct.groupBy("fp").agg(F.min("tid").alias("first")), "fps")
    same = distinct.select("tid", "fp").join(broadcast_if_small(fps, NARROW_ROWS), "fp").where("tid != first").select(F.col("tid").alias("a"), F.col("first").alias("b"))
    near = scratch.save(links(fps.select("fp"), scratch, radius), "near_links")
    first = lambda end: fps.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    near = near.join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    filed = distinct.select("tid", F.explode("bands").alias("key"))
    buckets = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("first")).where("n > 1").drop("n")
    buckets = scratch.save(buckets, "buckets")
    banded = filed.join(broadcast_if_small(buckets, NARROW_ROWS), "key").where("tid != first").select(F.col("tid").alias("a"), F.col("first").alias("b"))
    return same.union(near).union(banded.distinct())


def similar_groups(docs: DataFrame, scratch: Scratch, width: int, similarity: float, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(tk, doc_id, keep) of all rows: tk tells texts apart, and keep marks
    one (tk, doc_id) of each group: the smallest id, nulls last."""
    chars = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("tk"), chars.alias("chars"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            more = [pa.array([majority(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tk", "chars")), *more], ["doc_id", "tk", "chars", "fp", "bands"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = scratch.save(map_batches(texts, mark, f"doc_id {kind}, tk binary, chars long, fp long, bands array<long>"), "marked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    distinct = marked.groupBy("tk").agg(F.first("fp").alias("fp"), F.first("chars").alias("chars"), F.first("bands").alias("bands"), least.alias("least"))
    distinct = scratch.save(distinct.withColumn("tid", F.monotonically_increasing_id()), "distinct")

    near = connected_components(scratch.save(candidate_links(distinct, scratch, radius), "candidates"), scratch)
    rooted = scratch.save(near.withColumnRenamed("node", "tid").join(distinct.select("tid", "tk", "chars", F.col("least.doc_id").alias("least_id")), "tid"), "near_roots")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    small = F.least(F.ceil(F.col("n") / SMALL_BLOCK), F.lit(SMALL_BLOCKS))
    n_blocks = F.greatest(F.ceil(F.col("n") / SET_BLOCK), small, F.ceil(F.col("chars") / BLOCK_CHARS))
    sizes = scratch.save(sizes.select("root", "n", F.least(n_blocks, F.col("n")).cast("int").alias("n_blocks")), "near_sizes")
    wanted = scratch.save(rooted.join(broadcast_if_small(sizes.select("root", "n_blocks"), NARROW_ROWS), "root").select("tk", "tid", "least_id", "root", "n_blocks"), "wanted")
    n_dealt = sizes.agg(F.sum(F.col("n") * F.greatest(F.col("n_blocks") - 1, F.lit(1)))).first()[0] or 0

    found = texts.join(broadcast_if_small(wanted, NARROW_ROWS), "tk").where(F.col("doc_id").eqNullSafe(F.col("least_id")))
    own = F.pmod(F.xxhash64("tid"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 2, F.lit(0))), lambda i: i + (i >= F.col("own")).cast("int"))
    others = F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).otherwise(pairs)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("tid", "root", "own", "others")] + [pa.array(sets, pa.list_(pa.int64()))], ["tid", "root", "own", "others", "hashes"])

    found = found.withColumn("own", own).withColumn("others", others).select("tid", "root", "own", "others", "text")
    found = map_batches(found, shingle, "tid long, root long, own int, others array<int>, hashes array<long>")
    dealt = found.withColumn("other", F.explode("others")).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tid", "hashes")
    dealt = dealt.repartition(tasks_for(n_dealt, SET_BLOCK), "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches, ["root", "i", "j"]):
            sets = dict(zip(group["tid"].to_pylist(), (np.asarray(x.values) for x in group["hashes"])))
            keys, sets = list(sets), list(sets.values())
            empty = [k for k, x in enumerate(sets) if not len(x)]
            some = [k for k, x in enumerate(sets) if len(x)]
            edges = [(keys[k], keys[empty[0]]) for k in empty[1:]]
            if len(some) > 1:
                edges += [(keys[some[a]], keys[some[b]]) for a, b in similar_forest([sets[k] for k in some], similarity)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

    same = connected_components(scratch.save(map_batches(dealt, run, "a long, b long"), "similar_links"), scratch)
    grouped = distinct.select("tid", "tk", "least").join(same.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "tk", "least", F.coalesce("root", "tid").alias("root"))
    grouped = scratch.save(grouped, "grouped")
    best = scratch.save(grouped.groupBy("root").agg(F.min(F.struct("least", "tid")).alias("best")), "best")
    chosen = grouped.join(best, "root").where(F.col("tid") == F.col("best.tid")).select("tk", F.col("least.doc_id").alias("kept_id"))
    chosen = scratch.save(chosen.withColumn("chosen", F.lit(True)), "chosen")
    mine = F.col("chosen") & F.col("kept_id").eqNullSafe(F.col("doc_id"))
    return marked.select("tk", "doc_id").join(chosen, "tk", "left").select("tk", "doc_id", F.coalesce(mine, F.lit(False)).alias("keep"))


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: the row with the smallest id of each
    group, with all its columns. Groups are closed over pairs of texts whose
    sets of word shingles have the Jaccard similarity or more; these are
    verified exactly on whole texts.

    Candidates are texts whose SimHash fingerprints the bit-sliced comparison
    links, and, as a fingerprint's distance bounds no similarity, texts that
    share a band of minima. Links of candidates make candidate groups, in which
    every pair is verified, in blocks.

    Cases: texts that are null or empty, or without words, are one group; equal
    texts always are; of rows that are equal in id and text one stays, any;
    rows without an id come last; an empty table gives an empty result; further
    columns, whatever their names, stay as they are."""
    scratch = Scratch(docs.sparkSession, "dedup")
    marked = scratch.save(similar_groups(docs, scratch, width, similarity, radius, id_col, text_col), "verdicts")
    own, gone_key, gone_id = (unused(f"lexmill_{n}", docs) for n in ("key", "gone", "gone_id"))
    gone = scratch.save(marked.where("NOT keep").select(F.col("tk").alias(gone_key), F.col("doc_id").alias(gone_id)).distinct(), "gone")
    twice = scratch.save(marked.where("keep").groupBy("tk", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("tk").alias(gone_key)).distinct(), "twice")
    scratch.keep("gone", "twice")
    left = docs.withColumn(own, text_key(text_col))
    same = F.col(f"`{own}`") == F.col(gone_key)
    left = left.join(broadcast_if_small(gone, NARROW_ROWS), same & F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)), "left_anti")
    if not twice.isEmpty():
        repeated = broadcast_if_small(twice, NARROW_ROWS)
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([own]))
    return left.drop(own)
