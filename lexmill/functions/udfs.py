"""The few text functions that no built-in expresses, as Arrow-batched UDFs."""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T

_BLANK = re.compile(T.BLANK_MARKER)

# How anchors around a blank are tried, longest first, and how a gap between them counts.
ANCHORS = (18, 14, 10, 7, 5)
LAST_OFFSET = 4096


def _nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def _compact(x: str) -> str:
    return "".join(filter(str.isalnum, _nfkc(x).lower()))


def _starts(passage: str, part: str) -> list[int]:
    """All places of a part, overlapping ones too."""
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", passage)]


def _strength(gap: int) -> float | None:
    """What so many characters between both anchors say of the blank."""
    if gap > 120:
        return None
    return -1.0 if not gap else 1.0 if gap <= 48 else 0.25


def _best_of(passage: str, left: str, right: str) -> tuple[float, float] | None:
    """The strongest and weakest sign that left and the next right after it
    give, of the lefts that begin within the first ``LAST_OFFSET`` characters
    (and the one behind); None without any."""
    ends = [at + len(left) for at in _starts(passage, left)]
    ends = ends[: bisect.bisect_left(ends, LAST_OFFSET + len(left)) + 1]
    rights = _starts(passage, right) if ends else []
    after = (bisect.bisect_left(rights, e) for e in ends)
    signs = [x for e, k in zip(ends, after) if k < len(rights) and (x := _strength(rights[k] - e)) is not None]
    return (max(signs), min(signs)) if signs else None


def bridge(question: str | None, text: str | None) -> float:
    """1 if the passage fills a blank of the question between the words around
    it, 0.25 if it may, -1 if it only repeats them, 0 if they do not occur."""
    sides = [_compact(p) for p in _BLANK.split(_nfkc(question or "").lower())]
    passage = _compact(text or "") if len(sides) > 1 else ""
    high = low = None
    for left, right in zip(sides, sides[1:]):
        for n in ANCHORS if left and right and passage else ():
            if found := _best_of(passage, left[-n:], right[:n]):
                high = found[0] if high is None else max(high, found[0])
                low = found[1] if low is None else min(low, found[1])
            if (high or 0) > 0:
                break
    return 0.0 if high is None else high if high > 0 else low


def _option_similarity(left: str | None, right: str | None) -> float:
    a, b = _compact(left or ""), _compact(right or "")
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    pairs = [{x[i:i + 2] for i in range(max(1, len(x) - 1))} for x in (a, b)]
    return max(len(pairs[0] & pairs[1]) / len(pairs[0] | pairs[1]), difflib.SequenceMatcher(None, a, b).ratio())


@F.pandas_udf(DoubleType())
def _cloze_bridge(questions: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([bridge(q, t) if q is not None else 0.0 for q, t in zip(questions, texts)], dtype="float64")


def cloze_bridge(question: Column | str, text: Column | str) -> Column:
    """:func:`bridge`; questions without a blank send nothing to Python."""
    blank = T.nfkc(question).rlike(T.BLANK_MARKER)
    return _cloze_bridge(F.when(blank, T.col(question)), F.when(blank, T.col(text)))


@F.pandas_udf(DoubleType())
def option_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_option_similarity(a, b) for a, b in zip(left, right)], dtype="float64")
