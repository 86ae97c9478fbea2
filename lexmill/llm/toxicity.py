"""Toxicity by a classifier chain.

Categories are predicted in sequence by linear models on hashed words and word
starts; each later model also sees the probabilities of the earlier ones, and
is trained with their out-of-fold predictions, so that it meets them as they
will be on new texts. What a fold's model uses, its features and its lexicon of
abusive words included, is chosen from the other folds alone.

The label table says of a text only whether it is toxic. Two further categories
grade toxic texts by their abusive words, those that the sample shows on toxic
texts alone: ``repeated`` has three places or more of such words, ``varied``
three different ones or more. They are silver labels: a rule on the label and
the text gives them.

The models are fitted on a bounded sample: of either class at most
``PER_CLASS`` labelled documents, those with the smallest hashes. Features are
counted and chosen in Spark; to the driver come the chosen ones, ``MOST_FEATURES``
for each fold at most, and of each sampled text those that it has.

Cases: a null text counts as empty; a text without words has the probabilities
of no evidence; a text is toxic if its probability is above a half, so that no
evidence at all finds nothing; a document whose label is null, or which has
none, is scored but not trained on; with several labels for an id the largest
counts, with several texts for an id the first in order; whole texts count;
repeated rows get equal results; empty tables give empty results, and without
labels, or with labels of one class, nothing is found toxic. Only the named
columns are read, all of ``docs`` pass through; where ``docs`` has a column of
the name of a result, the result's name gets an underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, map_batches, release, small_batches, unused
from .license_scan import WORD_BYTES

CATEGORIES = ("toxic", "repeated", "varied")
PER_CLASS = 4000
HASH_BITS = 20
START = 5
FOLDS = 5
THRESHOLD = 0.5
#: A feature is used if so many sampled texts have it, and if the share of toxic texts that do is so many times that of others.
LEAST_TEXTS, LEAST_RATIO = 3, 8.0
MOST_FEATURES = 2048


def word_features(text: str | None) -> dict[int, int]:
    """Hashed words (even numbers) and word starts (odd ones) with their places."""
    out: dict[int, int] = {}
    crc, mask = zlib.crc32, (1 << HASH_BITS) - 1
    seen: dict[bytes, int] = {}
    for w in (text or "").encode().translate(WORD_BYTES).split():
        seen[w] = seen.get(w, 0) + 1
    for w, n in seen.items():
        i = (crc(w) & mask) << 1
        out[i] = out.get(i, 0) + n
        start = w.decode()[:START]
        if len(start) == START:
            i = (crc(start.encode()) & mask) << 1 | 1
            out[i] = out.get(i, 0) + n
    return out


@dataclass
class Chain:
    """``used``: feature to column; ``models``: (weights, bias, weights of the earlier probabilities) by category."""

    used: dict[int, int] = field(default_factory=dict)
    models: list[tuple[np.ndarray, float, np.ndarray]] = field(default_factory=list)
    held_out_errors: float = 0.0  # share of sampled texts that the models which did not see them get wrong

    def predict(self, present: np.ndarray) -> np.ndarray:
        """Probabilities by category for rows of present features (0 or 1)."""
        earlier = np.zeros((len(present), 0))
        for weights, bias, chained in self.models:
            p = _sigmoid(present @ weights + earlier @ chained + bias)
            earlier = np.column_stack([earlier, p])
        return earlier if self.models else np.zeros((len(present), len(CATEGORIES)))

    def rows(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), len(self.used)), np.float32)
        for k, text in enumerate(texts):
            for i in word_features(text):
                if (at := self.used.get(i)) is not None:
                    out[k, at] = 1
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, earlier: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """By gradient steps with momentum. Texts without any feature, which are
    most, differ in the earlier probabilities and the label alone; equal ones
    are one row with a weight."""
    some = x.any(1)
    few, weight = np.unique(np.column_stack([earlier[~some], y[~some]]), axis=0, return_counts=True)
    n, d = int(some.sum()), x.shape[1]
    rows = np.ones((n + len(few), d + earlier.shape[1] + 1), np.float32)
    rows[:n, :d], rows[n:, :d] = x[some], 0
    rows[:n, d:-1], rows[n:, d:-1] = earlier[some], few[:, :-1]
    target = np.r_[y[some], few[:, -1]].astype(np.float32)
    share = (np.r_[np.ones(n), weight] / max(1, len(y))).astype(np.float32)
    w, speed = np.zeros(rows.shape[1], np.float32), np.zeros(rows.shape[1], np.float32)
    hold = np.r_[np.full(len(w) - 1, l2), 0].astype(np.float32)
    for _ in range(steps):
        speed = 0.9 * speed - 1.6 * ((share * (_sigmoid(rows @ w) - target)) @ rows + hold * w)
        w = w + speed
    return w[:-1].astype(float), float(w[-1])


def fit_chain(features: list[np.ndarray], places: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray, chosen: list[np.ndarray], lexicon: list[np.ndarray]) -> Chain:
    """A chain from the sample: each text's features and the places of each,
    its label and its fold. ``chosen`` and ``lexicon``: the features to use and
    the abusive words, as each fold's model may know them, and last as all
    texts tell."""
    chain = Chain()
    if not toxic.any() or toxic.all():
        return chain
    text = np.repeat(np.arange(len(features)), [len(f) for f in features])
    at, n_at = np.concatenate(features), np.concatenate(places)

    def table(use: np.ndarray) -> np.ndarray:
        use = np.sort(use)
        x = np.zeros((len(features), len(use)), np.uint8)
        if len(use):
            column = np.minimum(np.searchsorted(use, at), len(use) - 1)
            found = use[column] == at
            x[text[found], column[found]] = 1
        return x

    def targets(words: np.ndarray) -> list[np.ndarray]:
        abusive = np.isin(at, words)
        n_places, kinds = np.bincount(text[abusive], n_at[abusive], len(features)), np.bincount(text[abusive], minlength=len(features))
        return [toxic.astype(float), toxic * (n_places >= 3), toxic * (kinds >= 3)]

    out_of_fold = np.zeros((len(features), len(CATEGORIES)))
    every = table(chosen[-1])
    goal = targets(lexicon[-1])
    tables, goals = [table(c) for c in chosen[:-1]], [targets(w) for w in lexicon[:-1]]
    for k in range(len(CATEGORIES)):
        earlier = out_of_fold[:, :k]
        for fold in range(FOLDS):
            held = folds == fold
            if held.any() and not held.all():
                x = tables[fold]
                w, b = _logistic(x[~held], earlier[~held], goals[fold][k][~held])
                out_of_fold[held, k] = _sigmoid(x[held] @ w[: x.shape[1]] + earlier[held] @ w[x.shape[1] :] + b)
        w, b = _logistic(every, earlier, goal[k])
        chain.models.append((w[: every.shape[1]], b, w[every.shape[1] :]))
    chain.used = {int(i): k for k, i in enumerate(np.sort(chosen[-1]))}
    chain.held_out_errors = float(((out_of_fold[:, 0] > THRESHOLD) != toxic.astype(bool)).mean())
    return chain


def _sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(id, y, fold, text), one row per id, those of the smallest hashes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.lit(3), F.col("id")))
    known = scratch.save(known, "known")
    chosen = [known.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    chosen = scratch.save(chosen[0].union(chosen[1]).select("id", "y", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")).coalesce(4), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # twice per_class rows at most
    return scratch.save(texts.groupBy("id", "y", "fold").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "sample")


def _chosen_features(listed: DataFrame, sizes: dict[tuple[int, int], int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features to use, and abusive words, without each fold and for all, of
    ``listed`` (fold, y, feature, n texts), with the number of texts by (fold, y)."""
    counts = [F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    table = listed.groupBy("feature").agg(*counts)
    chosen, lexicon = [], []
    for out in [*range(FOLDS), None]:
        keep = [f for f in range(FOLDS) if f != out]
        n_neg, n_pos = (sum(sizes.get((f, y), 0) for f in keep) for y in (0, 1))
        neg, pos = (sum((F.col(f"n{f}_{y}") for f in keep), F.lit(0)) for y in (0, 1))
        ratio = (pos / max(1, n_pos)) / ((neg + 0.5) / max(1, n_neg))
        good = table.select("feature", neg.alias("neg"), (pos * ratio).alias("score")).where((pos >= min(LEAST_TEXTS, max(1, n_pos))) & (ratio >= LEAST_RATIO))
        rows = good.orderBy(F.desc("score"), "feature").limit(MOST_FEATURES).collect()
        chosen.append(np.array(sorted(r.feature for r in rows), np.int64))
        lexicon.append(np.array([r.feature for r in rows if not r.neg and r.feature % 2 == 0], np.int64))
    return chosen, lexicon


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Chain:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, scratch, id_col, text_col, label_col, per_class)
    sizes = {(r.fold, r.y): r.n for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if {y for _, y in sizes} != {0, 1}:
        return Chain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([list(f) for f in found], pa.list_(pa.int64())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "fold")), *columns], ["id", "y", "fold", "at", "n"])

    kind = sample.schema["id"].dataType.simpleString()
    n_pos = [sum(n for (f, y), n in sizes.items() if y and f != out) for out in range(FOLDS)]
    counted = scratch.save(map_batches(sample, run, f"id {kind}, y int, fold int, at array<long>, n array<long>"), "features")
    # a feature that any fold may choose is on so many toxic texts; few are, and the others need not be counted
    least = min([LEAST_TEXTS, *(max(1, n) for n in n_pos)])
    may = counted.where("y = 1").select(F.explode("at").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("feature")
    may = broadcast_if_small(scratch.save(may, "may"))
    listed = counted.select("fold", "y", F.explode("at").alias("feature")).join(may, "feature").groupBy("fold", "y", "feature").agg(F.count("*").alias("n"))
    chosen, lexicon = _chosen_features(scratch.save(listed, "counts"), sizes)
    wanted = np.unique(np.concatenate(chosen))

    def only_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, y, fold = (batch.column(c).to_pylist() for c in ("at", "n", "y", "fold"))
            own = [np.isin(np.array(x, np.int64), wanted) for x in at]
            cut = lambda rows: pa.array([np.array(x, np.int64)[k] for x, k in zip(rows, own)], pa.list_(pa.int64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), cut(at), cut(n)], ["id", "y", "fold", "at", "n"])

    got = map_batches(counted, only_wanted, counted.schema.simpleString()[7:-1].replace(":", " ")).orderBy("id").collect()
    arrays = [[np.array(r[c], np.int64) for r in got] for c in ("at", "n")]
    return fit_chain(*arrays, np.array([r.y for r in got]), np.array([r.fold for r in got]), chosen, lexicon)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """``docs`` with p_toxic, p_repeated, p_varied and toxic."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col) if chain is None else chain

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(model.predict(model.rows(texts.to_pylist())).tolist(), pa.list_(pa.float64()))
        release()
        return out

    p = unused("lexmill_p", docs)
    scored = docs.withColumn(p, score(F.col(f"`{text_col}`")))
    results = {unused(f"p_{c}", docs): F.get(p, k) for k, c in enumerate(CATEGORIES)} | {unused("toxic", docs): F.get(p, 0) > THRESHOLD}
    return scored.withColumns(results).drop(p)
