"""Rule-based grading as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

FORMAT_PENALTY = -0.5
WRONG_WEIGHT = 0.5
# Groups of words that count as the same answer.
SYNONYMS = [
    ["对", "正确", "是", "yes", "true", "√"],
    ["错", "错误", "否", "no", "false", "×"],
    ["拒收", "reject", "退货"],
    ["特采", "waive", "让步接收"],
    ["放行", "release", "合格放行"],
    ["晶圆", "wafer", "硅片"],
    ["光刻胶", "光阻", "photoresist", "resist"],
    ["退火", "anneal", "annealing"],
    ["掺杂", "doping", "dopant"],
    ["离子注入", "ion implantation", "implant"],
]


def expand_synonyms(forms: Column, groups: list[list[str]] | None = None) -> Column:
    """Adds the members of each group that shares a form, in the groups' order,
    so that an earlier group can bring in a later one."""
    words = F.array(*(F.array(*(F.lit(T.loose_text(w)) for w in g)) for g in (SYNONYMS if groups is None else groups)))
    return F.aggregate(words, forms, lambda out, g: F.when(F.arrays_overlap(out, g), F.array_union(out, g)).otherwise(out))


def accepted(blank: Column, groups: list[list[str]] | None = None) -> Column:
    forms = F.concat(F.array(T.loose(blank)), F.transform(F.split(blank, "[/／]"), T.loose))
    return expand_synonyms(F.array_distinct(F.filter(forms, lambda x: x != "")), groups)


def grade_multiple(said: Column, gold: Column, mode: str = "partial_penalty", wrong_weight: float = WRONG_WEIGHT) -> Column:
    """``said`` and ``gold``: sorted arrays of letters."""
    right = F.size(F.array_intersect(said, gold))
    if mode == "exact":
        return F.when(said == gold, 1.0).otherwise(0.0)
    if mode == "f1":
        return F.when((F.size(said) == 0) & (F.size(gold) == 0), 1.0).when(right == 0, 0.0).otherwise(2.0 * right / (F.size(said) + F.size(gold)))
    wrong = F.size(F.array_except(said, gold))
    return F.when(F.size(gold) > 0, F.greatest(F.lit(0.0), (right - wrong_weight * wrong) / F.size(gold))).otherwise(0.0)


def grade(expected: Column | str, completion: Column | str, boxed: Column, mode: str = "partial_penalty", groups: list[list[str]] | None = None) -> Column:
    """The reward of a completion. ``boxed``: its last boxed answer, as
    ``text.boxed`` finds it."""
    kind, gold = T.expected_type(expected), T.strip(T.expected_body(expected))
    blanks = F.split(gold, r"\|\|\|")
    parts = F.filter(F.split(boxed, "[;；\n]"), lambda p: T.strip(p) != "")
    filled = F.filter(blanks, lambda b, i: (i < F.size(parts)) & F.array_contains(accepted(b, groups), T.loose(F.get(parts, i))))
    keywords = F.filter(blanks, lambda k: T.loose(k) != "")
    said = F.concat(T.loose(boxed), F.lit("|"), T.loose(completion))
    covered = F.filter(keywords, lambda k: F.exists(accepted(k, groups), lambda form: F.contains(said, form)))
    return (
        F.when(boxed.isNull(), FORMAT_PENALTY)
        .when(kind == "", (T.loose(boxed) == T.loose(expected)).cast("double"))
        .when(kind.isin("single", "bool"), (T.letters(boxed) == T.letters(gold)).cast("double"))
        .when(kind == "multiple", grade_multiple(T.letters(boxed), T.letters(gold), mode))
        .when(kind == "fill", F.size(filled) / F.size(blanks))
        .when(kind == "short", T.share(covered, keywords))
        .otherwise(0.0)
    )


def shaped(reward: Column, evidence: Column, open_training: Column, scale: float) -> Column:
    """Training on open questions adds a share of the evidence found, up to 1."""
    return F.when((reward >= 0) & open_training & F.lit(scale > 0), F.least(F.lit(1.0), reward + scale * evidence)).otherwise(reward)


def loss_multiplier(kind: Column, is_training: Column, multiplier: float) -> Column:
    return F.when(is_training & kind.isin("fill", "short"), max(0.0, min(1.0, multiplier))).otherwise(1.0)
