"""Multi-turn search episodes as a state machine, in batches and streams.

A turn either answers in a box and ends the episode, or searches within the
limit, or is asked once to correct itself and then ends with a penalty.
Retrieval and grading are done by joins before; a turn comes with the reward
its text would get and the evidence its search would find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grading
from ..functions import text as T

MAX_SEARCHES = 2
STATE = "searches int, must_answer boolean, corrected boolean, evidence double, ended boolean"
OUT = "conv_id long, turn long, action string, reward double, ended boolean, searches int, must_answer boolean, evidence double"


@dataclass
class State:
    searches: int = 0
    must_answer: bool = False
    corrected: bool = False
    evidence: float = 0.0
    ended: bool = False


def step(s: State, boxed: bool, searching: bool, reward: float, found: float, shaped: bool, max_searches: int = MAX_SEARCHES, scale: float = 0.0) -> tuple[str, float]:
    """Moves the state on; returns what happened and the reward."""
    if boxed:
        s.ended = True
        if shaped and scale > 0 and reward >= 0:
            reward = min(1.0, reward + scale * s.evidence)
        return "answer", reward
    if searching and not s.must_answer and s.searches < max_searches:
        s.searches += 1
        s.must_answer = s.searches >= max_searches
        if shaped and scale > 0:
            s.evidence = max(s.evidence, found)
        return "search", 0.0
    if s.corrected:
        s.ended = True
        return "format_error", grading.FORMAT_PENALTY
    s.must_answer = s.corrected = True
    return "correction", 0.0


def classify_turns(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.withColumn("boxed", T.boxed(text).isNotNull()).withColumn("searching", T.search_tag(text).isNotNull())


def _play(turns: pd.DataFrame, s: State, max_searches: int, scale: float) -> Iterator[tuple]:
    for t in turns.sort_values("turn").itertuples():
        if s.ended:
            return
        action, reward = step(s, t.boxed, t.searching, t.reward, t.found, t.shaped, max_searches, scale)
        yield (t.conv_id, t.turn, action, reward, s.ended, s.searches, s.must_answer, s.evidence)


COLUMNS = [c.split()[0] for c in OUT.split(", ")]
PLAYED = ["conv_id", "turn", "boxed", "searching", "reward", "found", "shaped"]
ARROW = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.bool_(), pa.float64()]


def run_batch(turns: DataFrame, max_searches: int = MAX_SEARCHES, scale: float = 0.0) -> DataFrame:
    """Assistant turns (conv_id, turn, boxed, searching, reward, found, shaped)
    with their outcome, up to each episode's end. Episodes are dealt and turns
    ordered by the engine; a task then plays them one after the other, which
    costs a step per turn and no call per episode."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = object(), State()
        for batch in batches:
            out = []
            for conv, turn, *rest in zip(*(batch.column(c).to_pylist() for c in PLAYED)):
                if conv != now:
                    now, s = conv, State()
                if not s.ended:
                    action, reward = step(s, *rest, max_searches, scale)
                    out.append((conv, turn, action, reward, s.ended, s.searches, s.must_answer, s.evidence))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), ARROW)], COLUMNS)

    dealt = turns.select(*PLAYED).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.mapInArrow(play, OUT)


def run_stream(turns: DataFrame, max_searches: int = MAX_SEARCHES, scale: float = 0.0, idle: str | None = "1 hour") -> DataFrame:
    """The same for a stream whose turns come in order; the state of an
    episode, or the mark that it has ended, is kept between batches until no turn
    has come for ``idle``. Such a stream runs batches without data, to see what
    has timed out, and so ends by being stopped. Without ``idle`` (None), for
    streams that end by themselves, nothing is ever dropped."""
    wait = idle and int(turns.sparkSession.sql(f"SELECT CAST(INTERVAL {idle} AS INTERVAL SECOND) AS x").first().x.total_seconds() * 1000)

    def play(key, groups, store):
        if store.hasTimedOut:
            store.remove()
            return
        s = State(*store.get) if store.exists else State()
        s = State(int(s.searches), bool(s.must_answer), bool(s.corrected), float(s.evidence), bool(s.ended))
        every = pd.concat(list(groups))
        out = pd.DataFrame(list(_play(every, s, max_searches, scale)), columns=COLUMNS)
        store.update((s.searches, s.must_answer, s.corrected, s.evidence, s.ended))
        if wait:
            store.setTimeoutDuration(wait)
        yield out

    return turns.groupBy("conv_id").applyInPandasWithState(play, OUT, STATE, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")


def running_evidence(turns: DataFrame) -> DataFrame:
    from ..operators import ranking

    return ranking.running_max(turns, ["conv_id"], ["turn"], "found", "evidence")


def loss_multiplier(turns: DataFrame, multiplier: float) -> DataFrame:
    return turns.withColumn("loss_multiplier", grading.loss_multiplier(F.col("kind"), F.col("is_training"), multiplier))
