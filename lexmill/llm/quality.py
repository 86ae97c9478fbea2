"""Quality classifier from a weak-label model.

Overlapping heuristic labellers vote on each document: junk, prose or nothing.
Expectation-maximisation over the counts of vote patterns (of all documents)
estimates how each labeller votes on either class, and so its accuracy; the
posterior of a document's pattern labels it. Documents of a bounded sample,
with these labels, train a linear scorer on hashed features (words, word shapes,
binned statistics), which judges all.

Nothing but the pattern counts (3 to the number of labellers at most) and the
features of the sample (``SAMPLE`` different rows at most, those of the smallest
hashes) comes to the driver.

Cases: a null text counts as empty; a text without words scores 0 and is
rejected; whole texts count, whatever their length; repeated rows get equal
scores; a null id is hashed like any other; an empty table gives an empty
result, and a table on which no labeller votes keeps everything that has words.
Only the text and id columns are read, all others pass through; where there is a
column of the name of the score, the score's name gets an underscore.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_threshold, map_batches, release, small_batches, unused

SAMPLE = 6000
FEATURES = 1 << 16
THRESHOLD = 0.5
ROUNDS = 60
JUNK, PROSE, NOTHING = 0, 1, 2

#: Letters become a (A for capitals), digits 0; other ASCII stays.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


@dataclass(frozen=True)
class Stats:
    """What the labellers look at."""

    words: int
    prose: float  # share of words shaped like words of prose
    symbols: float  # share of signs among the characters of words, but for . , ' -
    capitals: float  # share of capitals among ASCII letters
    bars: float  # share of words without letters and digits
    tails: float  # share of words that end in two signs or more
    stutter: float  # share of words that equal the word before
    run: int  # most equal words in a row
    repeats: float  # share of word pairs that occurred before
    variety: float  # distinct words over the words to the power 3/4
    shapes: dict[bytes, int]


def _squeeze(shape: bytes) -> bytes:
    out = bytearray()
    for c in shape:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out)


_KNOWN: dict[bytes, tuple] = {}


def _look(shape: bytes) -> tuple[bytes, bool, int, int, int, bool, bool]:
    """(squeezed shape, prose, signs, capitals, letters, bar, tail) of a word's shape."""
    if (known := _KNOWN.get(shape)) is None:
        letters = shape.count(b"a") + shape.count(b"A")
        signs = sum(c not in b"aA0.,'-" for c in shape)
        body = shape.rstrip(b".,;:?!")
        prose = len(shape) - len(body) <= 1 and body[1:] == b"a" * (len(body) - 1) and body[:1] in (b"a", b"A")
        known = (_squeeze(shape), prose, signs, shape.count(b"A"), letters, not letters and b"0" not in shape, len(shape) > 2 and all(c not in b"aA0" for c in shape[-2:]))
        if len(_KNOWN) < 20_000:
            _KNOWN[shape] = known
    return known


def stats(text: str | None) -> Stats:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return Stats(0, 0, 0, 0, 0, 0, 0, 0, 0, 0, {})
    shapes: Counter = Counter(raw.translate(SHAPE).split())
    squeezed: Counter = Counter()
    prose = signs = capitals = letters = bars = tails = chars = 0
    for shape, k in shapes.items():
        s, is_prose, sign, capital, letter, bar, tail = _look(shape)
        squeezed[s] += k
        prose += k * is_prose
        signs += k * sign
        capitals += k * capital
        letters += k * letter
        bars += k * bar
        tails += k * tail
        chars += k * len(shape)
    same = list(map(bytes.__eq__, words, words[1:]))
    stutter = sum(same)
    run = 1 + max(map(len, bytes(same).split(b"\0"))) if stutter else 1
    repeats = 1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0
    return Stats(n, prose / n, signs / chars, capitals / max(1, letters), bars / n, tails / n, stutter / n, run, repeats, len(set(words)) / n**0.75, squeezed)


def _above(junk: float, prose: float | None = None):
    """A labeller: junk from ``junk`` on, prose up to ``prose``."""
    return lambda x: JUNK if x >= junk else PROSE if prose is not None and x <= prose else NOTHING


#: (name, what it looks at, vote). They overlap: most junk meets several. A
#: defect's absence says little, so that most vote on junk alone.
LABELLERS = (
    ("prose_shape", lambda s: 1 - s.prose, _above(0.4, 0.1)),
    ("symbols", lambda s: s.symbols, _above(0.12)),
    ("capitals", lambda s: s.capitals, _above(0.6)),
    ("bars", lambda s: s.bars, _above(0.2)),
    ("tails", lambda s: s.tails, _above(0.2)),
    ("stutter", lambda s: s.stutter, _above(0.2)),
    ("run", lambda s: s.run, _above(5)),
    ("repeats", lambda s: s.repeats if s.words >= 20 else 0, _above(0.6)),
    ("variety", lambda s: -s.variety if s.words >= 40 else -1.0, _above(-0.35)),
)


def pattern(s: Stats) -> int:
    """All votes as one number in base 3; no votes for a text without words."""
    votes = (vote(look(s)) if s.words else NOTHING for _, look, vote in LABELLERS)
    return sum(v * 3**i for i, v in enumerate(votes))


def votes_of(p: int) -> list[int]:
    return [p // 3**i % 3 for i in range(len(LABELLERS))]


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], dict[str, float], float]:
    """Posterior of prose by pattern, the labellers' accuracies and the share of
    prose, by expectation-maximisation. An accuracy is the probability that a
    vote is right; labellers that do not vote say nothing. The share is that of
    the majority votes and is held: most labellers vote on junk alone, so that
    the votes do not tell a low share from low accuracies."""
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns]).reshape(len(patterns), len(LABELLERS))
    n = np.array([counts[p] for p in patterns], float)
    lead = (votes == PROSE).sum(1) - (votes == JUNK).sum(1)
    good = np.select([lead > 0, lead < 0], [0.95, 0.05], 0.5)  # the majority, to begin with
    accuracy, share = np.full(len(LABELLERS), 0.8), (n @ good + 1) / (n.sum() + 2)
    for _ in range(rounds):
        for i in range(len(LABELLERS)):
            junk, prose = n * (votes[:, i] == JUNK), n * (votes[:, i] == PROSE)
            accuracy[i] = (junk @ (1 - good) + prose @ good + 4) / (junk.sum() + prose.sum() + 5)
        weight = np.log(accuracy / (1 - accuracy))
        odds = np.log(share / (1 - share)) + (votes == PROSE) @ weight - (votes == JUNK) @ weight
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return dict(zip(patterns, good.tolist())), {name: float(a) for (name, _, _), a in zip(LABELLERS, accuracy)}, float(share)


def features(s: Stats, text: str | None) -> dict[int, float]:
    """Hashed features: square roots of the shares of words and of squeezed
    word shapes, and marks of the binned statistics."""
    out: dict[int, float] = {}
    crc = zlib.crc32
    for shape, k in s.shapes.items():
        i = crc(b"shape:" + shape) % FEATURES
        out[i] = out.get(i, 0.0) + k
    for word, k in Counter((text or "").encode().lower().split()).items():
        i = crc(word) % FEATURES
        out[i] = out.get(i, 0.0) + k
    out = {i: (v / s.words) ** 0.5 for i, v in out.items()}
    for name, x in (("stutter", s.stutter), ("repeats", s.repeats), ("run", min(s.run, 9) / 20), ("capitals", s.capitals), ("symbols", s.symbols), ("bars", s.bars), ("tails", s.tails), ("prose", 1 - s.prose)):
        i = crc(f"{name}:{min(9, int(x * 20))}".encode()) % FEATURES
        out[i] = out.get(i, 0.0) + 0.5
    return out


def train(at: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with momentum.
    Features come as (row, feature, value)."""
    weights = np.zeros(FEATURES)
    n = len(target)
    if not n:
        return weights, 3.0
    used, at = np.unique(at, return_inverse=True)
    w, speed = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[at], n) + w[-1], -30, 30)))
        gap = (p - target) / n
        speed = 0.9 * speed - 0.5 * np.append(np.bincount(at, value * gap[row], len(used)) + l2 * w[:-1], gap.sum())
        w = w + speed
    weights[used] = w[:-1]
    return weights, float(w[-1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    posteriors: dict[int, float]
    accuracies: dict[str, float]

    def score(self, text: str | None) -> float:
        s = stats(text)
        if not s.words:
            return 0.0
        found = features(s, text)
        z = self.bias + self.weights[list(found)] @ list(found.values())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The id is hashed to choose the sample, so that copies of a text do not
    enter it together."""
    narrow = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(stats(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["pattern"])

    counts = {r.pattern: r.n for r in map_batches(narrow, votes, "pattern long").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posteriors, accuracy, share = estimate(counts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            every = [stats(t) for t in texts]
            found = [features(s, t) for s, t in zip(every, texts)]
            columns = [pa.array([pattern(s) for s in every], pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), *columns], ["h", "pattern", "at", "value"])

    some = narrow.where(F.length("text") > 0).withColumn("h", F.xxhash64(F.lit(9), F.col("id"), F.col("text")))
    some = some.where(F.shiftrightunsigned("h", 33) < fit_threshold(sum(counts.values()), 2 * sample))  # about twice as many as wanted, if none repeat
    chosen = some.select("h").distinct().orderBy(F.shiftrightunsigned("h", 33), "h").limit(sample)
    features_of = map_batches(some.join(F.broadcast(chosen), "h").select("h", "text"), rows, "h long, pattern long, at array<int>, value array<float>")
    got = features_of.groupBy("h").agg(F.first(F.struct("pattern", "at", "value")).alias("x")).select("h", "x.*").orderBy("h").toArrow()
    at, value = (got[c].combine_chunks() for c in ("at", "value"))
    row = np.repeat(np.arange(len(got)), np.diff(at.offsets.to_numpy())) if len(got) else np.zeros(0, np.int64)
    target = np.array([posteriors.get(p, share) for p in got["pattern"].to_pylist()])
    weights, bias = train(at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float), row, target)
    return Model(weights, bias, posteriors, accuracy)


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())
        release()
        return out

    return score(text)


def classify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Model | None = None, score_name: str = "quality_score") -> DataFrame:
    """``docs`` with the score, from 0 (junk) to 1; ``THRESHOLD`` and more is kept."""
    small_batches(docs.sparkSession)
    model = fit(docs, text_col, id_col) if model is None else model
    return docs.withColumn(unused(score_name, docs), score_column(model, F.col(f"`{text_col}`")))
