"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to unit length and cut in half; each half has a codebook of
its own, and the pairs of codewords are the cells of a product grid. Equal
vectors of a label are one class. Every class is filed in its cell and visits
the nearest other cells by multi-sequence traversal: codewords of either half
are put in order, and a heap over pairs of places in these orders yields cells
from the nearest on, until the reach of the target recall. The cosines of what
it meets there are verified in double precision on the vectors as given.

How far a cell is from a vector is a bound: the sum over both halves of the
squared distance from the half to the codeword's side of its bisectors with
the other codewords. No vector of the cell can be nearer. The reach is the bound
that ``recall`` of the links in a bounded sample needed, each half of which is
some vector's own: nearly all links are much nearer than the worst case that
the least cosine allows, which is the reach for a recall of 1, with which
results equal brute force, and where the sample holds no links.

Of two cells, the vectors of the lower one visit the higher. Visits are
first matched with the cells that hold vectors of the label, which are few;
only then do vectors move, once per visit that is left. Cells are split into
blocks of ``BLOCK`` vectors; pairs of blocks are compared in separate tasks as
matrix products. They return numbers of links and spanning forests, never all
pairs.

Cases: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, nor does one without a label or an id; vectors
of different lengths do not link; copies of a vector link; repeated rows count
as further vectors; empty tables give empty results. Only the named columns are
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, fit_threshold, groups_of, hash31, map_batches, tasks_for
from .components import connected_components

BLOCK = 1024
#: Cells of more than half a block are dealt in smaller ones, up to so many, so that some thousand vectors spread.
SMALL_BLOCK, SMALL_BLOCKS = 256, 8
#: Vectors of the largest label that a cell is meant to hold on the average.
PER_CELL = 64
CODEWORDS = (4, 256)
#: Vectors that the codebooks and the reach are fitted on, and classes whose
#: links to the sample of their label tell the reach.
SAMPLE, PROBES = 20_000, 2_000
#: Share of the sample's links that the reach covers, by default.
RECALL = 0.9999
SLACK = 1e-6
#: Rows that a task compares, about.
TASK_ROWS = 4096


@dataclass
class Codebook:
    """One half's codewords. ``gap``: distances between them."""

    words: np.ndarray

    def __post_init__(self):
        self.gap = np.sqrt(np.maximum(0, ((self.words[:, None] - self.words[None]) ** 2).sum(2)))

    def _squares(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.words.T + (self.words * self.words).sum(1))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self._squares(x).argmin(1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Squared distance, at least, from each row to any point that is
        nearer to codeword i than to every other."""
        d = self._squares(x)
        near = d.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (d - d[np.arange(len(d)), near][:, None]) / (2 * self.gap[near])
            for j in np.argsort(self.words @ self.words.mean(0))[:: max(1, len(self.words) // 8)]:  # bisectors with some other codewords
                out = np.fmax(out, (d - d[:, j][:, None]) / (2 * self.gap[j]))
        out[~np.isfinite(out)] = 0
        return np.maximum(out, 0) ** 2


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> Codebook:
    rng = np.random.default_rng(5)
    distinct = np.unique(x, axis=0)
    words = distinct[rng.permutation(len(distinct))[:k]] if len(distinct) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        at = Codebook(words).nearest(x)
        sums, n = np.zeros_like(words), np.bincount(at, minlength=len(words))
        np.add.at(sums, at, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return Codebook(words)


@dataclass
class MultiIndex:
    """Codebooks of both halves by vector length, and the bound up to which cells are visited."""

    books: dict[int, tuple[Codebook, Codebook]]
    reach: float

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = unit.shape[1] // 2
        return unit[:, :h], unit[:, h:]

    def locate(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Home cell (i, j) and the bounds of both halves by codeword."""
        if (books := self.books.get(unit.shape[1])) is None:
            zero = np.zeros(len(unit), np.int64)
            return zero, zero, np.zeros((len(unit), 1)), np.zeros((len(unit), 1))
        (a, b), (x, y) = books, self.halves(unit)
        return a.nearest(x), b.nearest(y), a.bounds(x), b.bounds(y)

    def visits(self, a: np.ndarray, b: np.ndarray, home: int) -> list[int]:
        """The cells (i * len(b) + j) from ``home`` on, which is one of them,
        in the order of their bounds, up to the reach."""
        by_a, by_b, width = np.argsort(a, kind="stable"), np.argsort(b, kind="stable"), len(b)
        low, high = a[by_a].tolist(), b[by_b].tolist()
        heap, out = [(low[0] + high[0], 0, 0)], []
        while heap:
            bound, m, n = heapq.heappop(heap)
            if bound > self.reach:
                break
            cell = int(by_a[m]) * width + int(by_b[n])
            if cell >= home:
                out.append(cell)
            if n + 1 < width:
                heapq.heappush(heap, (low[m] + high[n + 1], m, n + 1))
            if not n and m + 1 < len(a):  # each pair has one way in
                heapq.heappush(heap, (low[m + 1] + high[0], m + 1, 0))
        return out if home in out else [home, *out]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    """Rows of one length from a list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def fit(classes: DataFrame, n: int, largest: int, least_cosine: float, recall: float, sample: int = SAMPLE) -> MultiIndex:
    """Codebooks on a bounded sample, and the reach for the target recall.
    ``largest``: the classes of the largest label."""
    limit = 2 * (1 - least_cosine) + SLACK
    chosen = classes.where(hash31(F.lit(1), F.col("vec")) < fit_threshold(n, sample)).select("label", F.size("vec").alias("d"), "vec", F.xxhash64("vec", "label").alias("h"))
    drawn = chosen.orderBy("h").limit(sample).toArrow()
    books, needed = {}, []
    k = int(np.clip(np.sqrt(largest / PER_CELL), *CODEWORDS))
    for d in sorted(set(drawn["d"].to_pylist())):
        part = drawn.filter(pa.compute.equal(drawn["d"], d))
        unit = unit_rows(matrix(part["vec"]))
        h = d // 2
        books[d] = (kmeans(unit[:, :h], k), kmeans(unit[:, h:], k)) if h else (Codebook(np.zeros((1, 0))), kmeans(unit, k))
        if recall < 1:
            labels = np.array(part["label"].to_pylist())
            i, j, a, b = MultiIndex(books, limit).locate(unit)
            home = i * b.shape[1] + j
            for at in range(0, min(len(unit), PROBES), 500):
                u, v = np.nonzero((unit[at:at + 500] @ unit.T >= least_cosine) & (labels[at:at + 500, None] == labels[None]))
                u = u + at
                u, v = u[u != v], v[u != v]
                low, high = np.where(home[u] <= home[v], u, v), np.where(home[u] <= home[v], v, u)
                needed.append(a[low, i[high]] + b[low, j[high]])
    found = np.concatenate(needed) if needed else np.zeros(0)
    return MultiIndex(books, float(min(limit, np.quantile(found, recall, method="higher") + SLACK)) if len(found) and recall < 1 else limit)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each node's group under the links u-v."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(
    vectors: DataFrame, least_cosine: float = 0.98, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    as_given = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # moves half as many bytes, and is as exact
    vec = F.col(vector_col) if as_given else F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(sound, vec).alias("vec"))
    rows = rows.withColumns({f"k{s}": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(s), F.col("vec"))) for s in (1, 2)})  # 128 bits name a vector
    classes = rows.where("vec IS NOT NULL").groupBy("label", "k1", "k2", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    per_label = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("largest")).first()
    index = fit(classes, per_label.n or 0, per_label.largest or 0, least_cosine, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home cells and the cells to visit, the home cell among them."""
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy()) if batch.num_rows else np.zeros(0)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(at))
                i, j, a, b = index.locate(unit_rows(matrix(part.column("vec"))))
                home = i * b.shape[1] + j
                visits = [index.visits(x, y, int(h)) for x, y, h in zip(a, b, home)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("cid", "label", "n")), pa.array(np.full(len(at), d), pa.int32()), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32())), part.column("vec")],
                    ["cid", "label", "n", "d", "home", "visits", "vec"],
                )

    label_kind, vec_kind = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    placed = map_batches(classes.select("cid", "label", "n", "vec"), place, f"cid long, label {label_kind}, n long, d int, home int, visits array<int>, vec {vec_kind}")
    placed = scratch.save(placed, "placed")

    key = ["label", "d", "cell"]
    filed = placed.groupBy("label", "d", F.col("home").alias("cell")).agg(F.count("*").alias("filed"))
    visits = placed.select("label", "d", "home", F.explode("visits").alias("cell"))
    visited = visits.groupBy(*key).agg(F.count("*").alias("visited"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.when(F.col(c) > BLOCK // 2, F.least(F.ceil(F.col(c) / SMALL_BLOCK), F.lit(SMALL_BLOCKS))).otherwise(1)).cast("int")
    sizes = filed.join(visited, key).where("filed > 1 OR visited > 1").select(*key, "filed", "visited", blocks("filed").alias("file_blocks"), blocks("visited").alias("visit_blocks"))
    sizes = scratch.save(sizes, "sizes")
    n_dealt = sizes.agg(F.sum(F.col("filed") * F.col("visit_blocks") + F.col("visited") * F.col("file_blocks"))).first()[0] or 0
    cells = broadcast_if_small(sizes.drop("filed", "visited"))
    salt = F.shiftrightunsigned(F.xxhash64("cid"), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: (salt % F.col(n)).cast("int")
    files = placed.select("label", "d", F.col("home").alias("cell"), "home", "cid", "n", "vec").join(cells, key).withColumn("fb", one("file_blocks")).withColumn("vb", every("visit_blocks")).withColumn("probe", F.lit(False))
    met = placed.select("label", "d", "home", F.explode("visits").alias("cell"), "cid", "n", "vec").join(cells, key)
    visits = met.withColumn("vb", one("visit_blocks")).withColumn("fb", every("file_blocks")).withColumn("probe", F.lit(True))
    keys = [*key, "fb", "vb"]
    dealt = files.select(*keys, "probe", "home", "cid", "n", "vec").unionByName(visits.select(*keys, "probe", "home", "cid", "n", "vec"))
    dealt = dealt.repartition(tasks_for(n_dealt, TASK_ROWS), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, cell, _, _), group in groups_of(batches, keys):
            probing = np.array(group["probe"].to_pylist())
            if probing.all() or not probing.any():
                continue
            unit = unit_rows(matrix(group["vec"]))
            cid, weight, home = (group[c].to_numpy() for c in ("cid", "n", "home"))
            mine, theirs = np.flatnonzero(probing), np.flatnonzero(~probing)
            once = (home[mine] != cell)[:, None] | (cid[mine][:, None] < cid[theirs][None])  # pairs within a cell count from one side
            u, v = np.nonzero((unit[mine] @ unit[theirs].T >= least_cosine) & once)
            if not len(u):
                continue
            u, v = mine[u], theirs[v]
            ids, inverse = np.unique(cid, return_inverse=True)
            roots = _roots(len(ids), inverse[u], inverse[v])
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, inverse[u], weight[v])
            np.add.at(total, inverse[v], weight[u])
            out = (total > 0) | (roots != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(total[out]), pa.array(ids[roots[out]])], ["cid", "links", "root"])

    found = scratch.save(map_batches(dealt, run, "cid long, links long, root long"), "found")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    name = ["label", "k1", "k2"]
    known = classes.select("cid", *name, "least", "n").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = scratch.save(known.select(*name, "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "known")
    least = scratch.save(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = scratch.save(known.join(least, "root").select(*name, "n_links", "component_id"), "named")
    scratch.keep("named")
    joined = rows.select("vec_id", *name).join(known, name, "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
