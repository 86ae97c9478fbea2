"""Rewards and prompts by name, so that a configuration can choose them.

A reward is either an expression over the columns of a row or a function of
whole lists (queries, completions, expected answers), which runs per Arrow
batch. A prompt is an expression or a function of one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grading
from ..functions import text as T

REWARDS: dict[str, tuple[Callable, bool]] = {}
PROMPTS: dict[str, tuple[Callable, bool]] = {}


def reward(name: str, batched: bool = False) -> Callable[[Callable], Callable]:
    """Registers ``fn(query, completion, expected)`` over columns, or, with
    ``batched``, over lists of strings, returning a list of numbers."""

    def add(fn: Callable) -> Callable:
        REWARDS[name] = (fn, batched)
        return fn

    return add


@reward("rules")
def by_rules(query: Column, completion: Column, expected: Column) -> Column:
    return grading.grade(expected, completion, T.boxed(completion))


def with_reward(rows: DataFrame, name: str, query: str = "query", completion: str = "completion", expected: str = "expected_answer", out: str = "reward") -> DataFrame:
    """Rows with the named reward. A function that returns another number of
    rewards than it was given rows is an error."""
    if name not in REWARDS:
        raise KeyError(f"there is no reward {name!r}, but {sorted(REWARDS)}")
    fn, batched = REWARDS[name]
    if not batched:
        return rows.withColumn(out, fn(F.col(query), F.col(completion), F.col(expected)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(fn(batch[query].tolist(), batch[completion].tolist(), batch[expected].tolist()))
            if len(found) != len(batch):
                raise ValueError(f"reward {name!r} returned {len(found)} numbers for {len(batch)} rows")
            yield batch.assign(**{out: [float(x) for x in found]})

    return rows.mapInPandas(run, rows.withColumn(out, F.lit(None).cast("double")).schema)


def prompt(name: str, per_text: bool = False) -> Callable[[Callable], Callable]:
    """Registers a renderer of prompts, over a column or, with ``per_text``, over one text."""

    def add(fn: Callable) -> Callable:
        PROMPTS[name] = (fn, per_text)
        return fn

    return add


@prompt("plain")
def as_it_is(query: Column) -> Column:
    return query


def rendered(query: Column, name: str) -> Column:
    if name not in PROMPTS:
        raise KeyError(f"there is no prompt {name!r}, but {sorted(PROMPTS)}")
    fn, per_text = PROMPTS[name]
    if not per_text:
        return fn(query)

    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return render(query)
