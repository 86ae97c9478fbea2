"""Offline reports on retrieval, reranking and memory.

A report is one plan over tables of stages: (query_id, stage, rank, source,
text, score) for what each way of retrieving finds, and from it the share of
the answers' items that the texts hold, per question, type and stage. Questions
are sampled by the hash of seed and id; expected answers are only measured
with, and never reach a search or a scorer. Models (rewriter, selector, judge,
teacher) are callables that get batches of plain rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grading, udfs
from ..functions import text as T
from ..sources.scratch import Scratch
from . import evaluation, ranking, rerank, retrieval

OPEN_TYPES, CLOSED_TYPES = ("fill", "short"), ("single", "multiple", "bool")
# Sets of weights that are compared, in the order of the features.
WEIGHT_GRID = {
    "default": (0.35, 0.20, 0.10, 0.20, 0.10, 0.05, 0.75, 0.08, -0.10, -0.80, -0.25),
    "answer_role": (0.15, 0.10, 0.05, 0.45, 0.20, 0.05, 1.00, 0.65, -0.20, -1.20, -0.30),
    "answer_role_strict": (0.10, 0.05, 0.02, 0.60, 0.25, 0.05, 1.20, 1.00, -0.35, -1.50, -0.40),
    "answer_role_soft": (0.25, 0.15, 0.08, 0.30, 0.15, 0.05, 0.85, 0.30, -0.15, -1.00, -0.25),
}
HOLDOUT = 5


# ---- questions ----------------------------------------------------------------


def questions_of(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(query_id, kind, query, question, group_key, expected_answer)."""
    question = T.question_text("query")
    return rows.select(F.col(order).alias("query_id"), T.expected_type("expected_answer").alias("kind"), "query", question.alias("question"), T.compact(question).alias("group_key"), "expected_answer")


def held_out(key: Column, denominator: int = HOLDOUT) -> Column:
    """Whether a question is held out: its key alone decides, so that rows of
    one question are never on both sides."""
    return ranking.stable_bucket(key, denominator) == 0


def sample(questions: DataFrame, per_type: int, seed: int = 42, kinds: tuple[str, ...] = OPEN_TYPES, only_held_out: bool = False) -> DataFrame:
    asked = questions.where(F.col("kind").isin(*kinds))
    asked = asked.where(held_out(F.col("group_key"))) if only_held_out else asked
    return ranking.stratified(asked, "kind", "query_id", max(1, per_type), seed).drop("rank")


# ---- stages ---------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    top_k: int = 3
    candidate_k: int = 80
    max_per_source: int = 4
    query_expansion: bool = True
    structural: bool = True
    aligned: bool = True


@dataclass
class Stages:
    """What is retrieved for a set of questions, stored, by stage."""

    index: retrieval.Index
    questions: DataFrame
    options: Options
    scratch: Scratch

    def with_texts(self, hits: DataFrame) -> DataFrame:
        """(query_id, rank, source, text, score)."""
        texts = self.index.chunks.select("chunk_id", "text")
        return retrieval.small(hits).join(texts, "chunk_id").select("query_id", "rank", "source", "text", (F.col("score_e9") / retrieval.UNIT).alias("score"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.save(df, name)

    def with_question(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.questions.select("query_id", "question"), "query_id")

    def reranked(self, hits: DataFrame, k: int, baseline: DataFrame, weights=rerank.WEIGHTS) -> DataFrame:
        out = rerank.rerank(self.with_question(hits), k, weights, baseline=baseline.where("rank = 1").select("query_id", "source", "text"))
        return out.select("query_id", F.col("pick").alias("rank"), "source", "text", F.col("rerank_score").alias("score"))

    def snippets(self, hits: DataFrame, chars: int) -> DataFrame:
        cut = rerank.snippets(self.with_question(hits).select("query_id", "rank", "source", "score", "question", "text"), chars)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        return cut.select("query_id", place.alias("rank"), "source", "text", "score")


def stages(index: retrieval.Index, questions: DataFrame, options: Options = Options()) -> Stages:
    scratch = Scratch(index.chunks.sparkSession, "report")
    return Stages(index, scratch.save(questions, "questions"), options, scratch)


def baseline(s: Stages) -> DataFrame:
    asked = s.questions.select("query_id", F.col("question").alias("query"))
    return s.save(s.with_texts(retrieval.search(s.index, asked, s.options.top_k, 2)), "baseline")


def candidate_hits(s: Stages, more: DataFrame | None = None) -> DataFrame:
    """Hits of all variants of the questions; ``more``: (query_id, variant,
    query) to search with as well."""
    views = T.query_variants("question") if s.options.query_expansion else F.array("question")
    variants = s.questions.select("query_id", F.posexplode(views).alias("variant", "query"))
    variants = variants if more is None else variants.unionByName(more.select("query_id", F.col("variant").cast("int").alias("variant"), "query"))
    name = "candidates" if more is None else "more_candidates"
    return s.save(retrieval.search_union(s.index, variants, s.options.candidate_k, s.options.max_per_source), name)


def expanded_hits(s: Stages, hits: DataFrame, name: str = "expanded") -> DataFrame:
    if not s.options.structural:
        return hits
    asked = s.questions.select("query_id", F.col("question").alias("query"))
    return s.save(retrieval.expand(s.index, asked, hits, aligned=s.options.aligned), name)


# ---- measures --------------------------------------------------------------------


def stage_coverage(s: Stages, named: dict[str, DataFrame]) -> DataFrame:
    """(query_id, kind, stage, coverage, copy_rate, chars, n) of every question
    and stage; a stage that found nothing covers nothing."""
    found = None
    for stage, hits in named.items():
        part = hits.select("query_id", F.lit(stage).alias("stage"), "rank", "source", "text")
        found = part if found is None else found.unionByName(part)
    found = s.save(found, "stages_" + "_".join(sorted(named)))
    passages = evaluation.passages(found, ["query_id", "stage"])
    copied = s.with_question(found).withColumn("bridge", udfs.cloze_bridge("question", "text"))
    copied = copied.withColumn("copy", T.copy_score("question", "text", F.col("bridge")) >= 0.5)
    stats = copied.groupBy("query_id", "stage").agg(F.avg(F.col("copy").cast("double")).alias("copy_rate"), F.sum(F.length("text")).cast("double").alias("chars"), F.count("*").alias("n"))
    every = s.questions.select("query_id", "kind", "expected_answer", F.explode(F.array(*map(F.lit, named))).alias("stage"))
    rows = every.join(passages, ["query_id", "stage"], "left").join(stats, ["query_id", "stage"], "left").withColumn("passage", F.coalesce("passage", F.lit("")))
    rows = evaluation.evidence_coverage(rows, "expected_answer", "passage", "coverage")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("query_id", "kind", "stage", "coverage", zero("copy_rate"), zero("chars"), zero("n"))


def presence_coverage(questions: DataFrame, present: DataFrame) -> DataFrame:
    """(query_id, kind, coverage) by the forms that a corpus holds at all."""
    items = questions.select("query_id", "kind", F.posexplode_outer(T.gold_items("expected_answer")).alias("item", "forms"))
    forms = items.select("query_id", "kind", "item", F.explode_outer("forms").alias("form")).join(present.withColumn("held", F.lit(1)), "form", "left")
    each = forms.groupBy("query_id", "kind", "item").agg(F.max(F.coalesce("held", F.lit(0))).alias("held"))
    return each.groupBy("query_id", "kind").agg(F.avg("held").cast("double").alias("coverage"))


def means(rows: DataFrame, measures: tuple[str, ...] = ("coverage", "copy_rate", "chars", "n")) -> DataFrame:
    """(kind, stage, count, means): of each type, and of all (kind null)."""
    return rows.groupingSets([["kind", "stage"], ["stage"]], "kind", "stage").agg(F.count("*").alias("count"), *(F.avg(m).alias(m) for m in measures))


def by_stage(rows: DataFrame, measure: str = "coverage", stages_: list[str] | None = None) -> DataFrame:
    """One row per question with a column for each stage."""
    return rows.groupBy("query_id", "kind").pivot("stage", stages_).agg(F.first(measure))


# ---- reports ----------------------------------------------------------------------

#: Differences of stages' mean coverage that the funnel tells: name, stage, stage it is taken from.
GAPS = (
    ("candidate_recall_gap", "candidate_pool", "corpus"), ("structural_gain", "candidate_pool", "expanded_pool"), ("top3_selection_gap", "reranked_top3", "expanded_pool"),
    ("snippet_compression_gap", "snippet_pool", "expanded_pool"), ("packing_selection_gap", "packed", "snippet_pool"), ("packed_gain_vs_top3", "reranked_top3", "packed"),
)


def retrieval_ab(index: retrieval.Index, rows: DataFrame, per_type: int = 64, seed: int = 42, options: Options = Options(candidate_k=20, query_expansion=False, structural=False, aligned=False), packing_k: int = 8, chars: int = 140) -> dict[str, DataFrame]:
    """Plain search against the reranked candidates: ``funnel`` (kind, stage,
    means), ``gaps`` (name, value), ``counters`` (name, value), ``changed`` (the
    first twelve questions whose coverage moved) and ``reranker``, the
    cross-validated linear reranker."""
    s = stages(index, sample(questions_of(rows), per_type, seed), options)
    base = baseline(s)
    raw = candidate_hits(s)
    wide = expanded_hits(s, raw)
    pools = {"candidate_pool": s.save(s.with_texts(raw), "raw_texts"), "expanded_pool": s.save(s.with_texts(wide), "wide_texts")}
    reranked = s.save(s.reranked(pools["expanded_pool"], options.top_k, base), "reranked")
    cut = s.save(s.snippets(pools["expanded_pool"], chars), "snippets")
    packed = s.save(s.reranked(cut, packing_k, s.snippets(base.where("rank = 1"), chars)), "packed")
    named = {"baseline_top3": base, **pools, "snippet_pool": cut, "packed": packed, "reranked_top3": reranked}
    rows_ = stage_coverage(s, named)
    forms = s.questions.select(F.explode(F.flatten(T.gold_items("expected_answer"))).alias("form"))
    present = evaluation.gold_presence(forms, index.chunks.select(retrieval.passage().alias("passage")))
    corpus = presence_coverage(s.questions, s.save(present, "present")).select("query_id", "kind", F.lit("corpus").alias("stage"), "coverage", *(F.lit(0.0).alias(c) for c in ("copy_rate", "chars")), F.lit(0).alias("n"))
    rows_ = s.save(rows_.unionByName(corpus), "measured")
    wide_rows = by_stage(rows_, stages_=["corpus", *named])
    mean = {c: F.avg(c) for c in ["corpus", *named]}
    gaps = wide_rows.agg(*((mean[b] - mean[a]).alias(n) for n, a, b in GAPS))
    delta = F.col("reranked_top3") - F.col("baseline_top3")
    keys = lambda hits, c: hits.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("source", F.md5(F.col("text").cast("binary")).alias("t")))).alias(c))
    other = keys(pools["candidate_pool"], "a").join(keys(pools["expanded_pool"], "b"), "query_id", "full_outer").select("query_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("restructured"))
    of = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    counters = wide_rows.join(other, "query_id", "left").agg(
        F.count("*").alias("samples"), of(delta > 0).alias("improved"), of(delta < 0).alias("regressed"), of(F.col("restructured")).alias("structural_changed"),
        of(F.col("expanded_pool") > F.col("candidate_pool")).alias("structural_coverage_improved"), of(F.col("corpus") > F.col("candidate_pool")).alias("candidate_missed_corpus"),
        of(F.col("expanded_pool") > F.col("reranked_top3")).alias("reranker_dropped_evidence"),
    )
    shown = wide_rows.where(delta != 0).orderBy("query_id").limit(12).join(s.questions.select("query_id", "question"), "query_id").select("query_id", "kind", F.left("question", F.lit(180)).alias("question"), "baseline_top3", "reranked_top3")
    model = reranker_validation(s, cut, wide_rows.select("query_id", F.col("reranked_top3").alias("baseline")), packing_k)
    return {"funnel": means(rows_), "gaps": _long(gaps), "counters": _long(counters), "changed": shown, **model}


def _long(row: DataFrame) -> DataFrame:
    """A row of figures as (name, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("x")).select("x.name", "x.value")


def weight_grid(index: retrieval.Index, rows: DataFrame, per_type: int = 32, seed: int = 42, options: Options = Options(), grid: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(kind, stage, count, coverage, copy_rate, chars, n, gain): each set of
    weights on the same candidates, against plain search (stage ``baseline``)."""
    s = stages(index, sample(questions_of(rows), per_type, seed), options)
    base = baseline(s)
    pool = s.save(s.with_texts(expanded_hits(s, candidate_hits(s))), "pool")
    named = {"baseline": base} | {name: s.save(s.reranked(pool, options.top_k, base, w), f"by_{name}") for name, w in (WEIGHT_GRID if grid is None else grid).items()}
    found = s.save(means(stage_coverage(s, named)), "means")
    plain = found.where("stage = 'baseline'").select(F.col("kind").alias("k"), F.col("coverage").alias("plain"))
    return found.join(F.broadcast(plain), F.col("kind").eqNullSafe(F.col("k"))).withColumn("gain", F.col("coverage") - F.col("plain")).drop("k", "plain")


def expansion_report(index: retrieval.Index, rows: DataFrame, options: Options = Options(), most: int = 3, least: float = 0.25) -> dict[str, DataFrame]:
    """Search with the answers of similar training questions as further
    queries, on held-out questions: ``means`` and ``counters``."""
    every = questions_of(rows).where(F.col("kind").isin(*OPEN_TYPES))
    s = stages(index, every.where(held_out(F.col("group_key"))), options)
    train = s.save(every.where(~held_out(F.col("group_key"))), "train")
    if s.questions.isEmpty() or train.isEmpty():
        raise ValueError("there are no questions to train with, or none are held out")
    base = baseline(s)
    near = retrieval.nearest_texts(train.select(F.col("query_id").alias("train_id"), F.col("question").alias("text")), s.questions.select("query_id", F.col("question").alias("text")), most, least)
    answers = train.select(F.col("query_id").alias("train_id"), T.supervised_answer("expected_answer").alias("answer"))
    near = s.save(near.join(answers, "train_id").where("answer != ''"), "near")
    more = s.with_question(near).select("query_id", "rank", F.posexplode(F.array("answer", F.concat("question", F.lit("\n"), "answer"))).alias("half", "query"))
    more = more.select("query_id", (1000 + F.col("rank") * 2 + F.col("half")).alias("variant"), "query")
    plain = s.save(s.reranked(s.with_texts(expanded_hits(s, candidate_hits(s))), options.top_k, base), "plain")
    helped = s.save(s.reranked(s.with_texts(expanded_hits(s, candidate_hits(s, more), "more_expanded")), options.top_k, base), "helped")
    measured = stage_coverage(s, {"baseline": plain, "supervised": helped})
    listed = lambda hits, c: hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias(c))
    changed = listed(plain, "a").join(listed(helped, "b"), "query_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    per = s.questions.select("query_id").join(near.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("sim_e9").alias("sim")), "query_id", "left")
    counters = per.agg(F.count("*").alias("samples"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_neighbours"), F.coalesce(F.sum("sim") / F.sum("n") / retrieval.UNIT, F.lit(0.0)).alias("mean_similarity"))
    return {"means": means(measured), "counters": _long(counters.crossJoin(changed.agg(F.count("*").alias("changed"))))}  # two single rows


def reranker_validation(s: Stages, pool: DataFrame, baselines: DataFrame, k: int, folds: int = 4) -> dict[str, DataFrame | dict]:
    """A linear reranker fitted on how much of an answer each text holds,
    measured on whole questions held out: ``reranker`` (kind, fold, count,
    coverage, baseline, regressed; kind and fold null for all) and ``model``."""
    featured = rerank.features(s.with_question(pool))
    one = featured.join(s.questions.select("query_id", "kind", "group_key", "expected_answer"), "query_id").withColumn("passage", F.concat("source", F.lit("\n"), "text"))
    labelled = evaluation.evidence_coverage(one, "expected_answer", "passage", "label").withColumn("identity", F.concat_ws(":", "kind", "group_key"))
    labelled = s.save(labelled, "labelled")
    if labelled.isEmpty():
        return {"reranker": labelled.groupBy("kind").agg(F.count("*").alias("count")), "model": {}}
    predicted = rerank.cross_validate(labelled, "query_id", "query_id", "label", rerank.FEATURES, folds, identity="identity")
    order = [F.desc("prediction"), F.desc("score"), "rank"]
    chosen = s.save(ranking.cap_with_refill(predicted.withColumn("first_rank", F.col("rank")), ["query_id"], "source", order, k, 2), "chosen")
    held = evaluation.passages(chosen.select("query_id", "rank", "source", "text"), ["query_id"]).join(chosen.select("query_id", "fold").distinct(), "query_id")
    held = evaluation.evidence_coverage(held.join(s.questions.select("query_id", "kind", "expected_answer"), "query_id"), "expected_answer", "passage", "coverage").join(baselines, "query_id")
    figures = [F.count("*").alias("count"), F.avg("coverage").alias("coverage"), F.avg("baseline").alias("baseline"), F.sum((F.col("coverage") < F.col("baseline")).cast("long")).alias("regressed")]
    report = held.groupingSets([["kind"], ["fold"], []], "kind", "fold").agg(*figures)
    return {"reranker": report, "model": rerank.fit_ridge(labelled, "query_id", "label", rerank.FEATURES)}


# ---- memory ---------------------------------------------------------------------------


def memory_entries(rows: DataFrame, kinds: tuple[str, ...] = ("multiple", "bool"), order: str = "ord") -> DataFrame:
    """(train_id, kind, question, answer, text): the training questions of the
    types, each (question, answer) once, the first by ``order``."""
    question = T.question_text("query")
    listed = rows.select(F.col(order).alias("train_id"), T.question_type("query").alias("kind"), question.alias("question"), T.memory_payload("expected_answer").alias("answer"))
    listed = listed.where(F.col("kind").isin(*kinds)).withColumns({"text": T.compact("question"), "answer_key": T.compact("answer")}).where("text != '' AND answer_key != ''")
    return ranking.keep_first(listed, ["kind", "text", "answer_key"], ["train_id"]).drop("answer_key")


def memory_search(entries: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.15, fill: bool = False) -> DataFrame:
    """(query_id, kind, train_id, rank, similarity) of queries (query_id,
    kind, text): the nearest entries of the same type, whose n-grams are weighed
    within the type. ``fill``: the first entries follow where fewer are similar."""
    found = None
    for kind in sorted(r.kind for r in queries.select("kind").distinct().collect()):  # the types
        train, asked = entries.where(F.col("kind") == kind), queries.where(F.col("kind") == kind)
        near = retrieval.nearest_texts(train, asked, k, least).select("query_id", "train_id", (F.col("sim_e9") / retrieval.UNIT).alias("similarity"))
        if fill:
            first = train.orderBy("train_id").limit(k).select("train_id")
            rest = asked.select("query_id").crossJoin(F.broadcast(first)).join(near, ["query_id", "train_id"], "left_anti")  # k rows
            near = near.unionByName(rest.withColumn("similarity", F.lit(0.0)))
        near = near.withColumn("kind", F.lit(kind))
        found = near if found is None else found.unionByName(near)
    if found is None:
        return queries.select("query_id", "kind", F.lit(0).cast("long").alias("train_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("similarity")).where("false")
    return ranking.top_per_group(found, ["query_id"], [F.desc("similarity"), "train_id"], k).select("query_id", "kind", "train_id", "rank", "similarity")


def memory_neighbours(rows: DataFrame, scratch: Scratch, kinds: tuple[str, ...], k: int) -> tuple[DataFrame, DataFrame]:
    """(questions, pairs): held-out questions with their nearest training
    questions of the same type: pairs have query_id, kind, query,
    expected_answer, rank, similarity and the neighbour's query and answer."""
    every = scratch.save(questions_of(rows).where(F.col("kind").isin(*kinds)), "questions")
    sides = every.withColumns({"held": held_out(F.col("group_key")), "text": F.regexp_replace(F.lower("question"), r"\s\s+", " ")})
    train = sides.where(~F.col("held")).withColumnRenamed("query_id", "train_id")
    near = scratch.save(memory_search(train, sides.where("held"), k, 0.0, fill=True), "near")
    other = train.select("train_id", F.col("query").alias("other_query"), F.col("expected_answer").alias("other_answer"))
    own = every.select("query_id", "query", "expected_answer")
    return every, scratch.save(near.join(own, "query_id").join(other, "train_id"), "pairs")


def boxed_answer(expected: Column | str) -> Column:
    """An expected answer as the answer of a model."""
    payload = F.when(T.expected_type(expected) != "", T.strip(T.expected_body(expected))).otherwise(T.strip(expected))
    return F.concat(F.lit("\\boxed{"), F.replace(payload, F.lit("|||"), F.lit(";")), F.lit("}"))


def memory_report(rows: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """How the answers of the nearest training questions would be graded:
    ``by_type`` (kind null for all) and ``confidence``."""
    scratch = Scratch(rows.sparkSession, "memory")
    every, pairs = memory_neighbours(rows, scratch, CLOSED_TYPES + OPEN_TYPES, k)
    said = pairs.withColumn("completion", boxed_answer("other_answer"))
    graded = scratch.save(said.withColumn("reward", grading.grade("expected_answer", "completion", T.boxed("completion"))).withColumn("answer_key", T.compact("other_answer")), "graded")
    votes = graded.groupBy("query_id", "answer_key").agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("weight"), F.max_by("reward", "rank").alias("reward"))
    best = votes.groupBy("query_id").agg(F.max_by("reward", F.struct("weight", "answer_key")).alias("vote"))
    per = graded.groupBy("query_id", "kind").agg(F.max(F.when(F.col("rank") == 1, F.col("reward"))).alias("top1"), F.max("reward").alias("oracle"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity"))
    per = scratch.save(per.join(best, "query_id"), "per_question")
    report = per.groupingSets([["kind"], []], "kind").agg(
        F.count("*").alias("samples"), F.avg("top1").alias("top1_reward"), F.avg("vote").alias("vote_reward"), F.avg("oracle").alias("oracle_reward"), F.avg("similarity").alias("mean_similarity")
    )
    return {"by_type": report, "confidence": evaluation.confidence_table(per, "similarity", "top1")}


def option_report(rows: DataFrame, k: int = 5, option_levels: tuple[float, ...] = (0.25, 0.40, 0.55), vote_levels: tuple[float, ...] = (0.30, 0.50, 0.70)) -> DataFrame:
    """(option_level, vote_level, samples, raw_reward, mapped_reward,
    oracle_reward, gain, best): letters of neighbours' answers mapped to the
    question's own options by the likeness of their texts, weighed by
    similarity, for each pair of levels."""
    scratch = Scratch(rows.sparkSession, "options")
    _, pairs = memory_neighbours(rows, scratch, CLOSED_TYPES, k)
    raw = pairs.where("rank = 1").withColumn("completion", boxed_answer("other_answer"))
    raw = raw.select("query_id", "kind", "expected_answer", grading.grade("expected_answer", "completion", T.boxed("completion")).alias("raw"))
    own, other = T.options("query"), T.options("other_query")
    letters = pairs.select("query_id", "rank", "similarity", F.posexplode_outer(own).alias("pos", "own"), other.alias("others"), T.letters(T.expected_body("other_answer")).alias("letters"))
    held = letters.select("query_id", "rank", "similarity", "pos", "own", F.explode(F.filter("others", lambda o: F.array_contains(F.col("letters"), o["letter"]))).alias("other")).where("own IS NOT NULL AND other.text != ''")
    scored = held.withColumn("score", udfs.option_similarity(F.col("other.text"), F.col("own.text")))
    best = scored.groupBy("query_id", "rank", "similarity", F.col("other.letter").alias("from")).agg(F.max(F.struct("score", (-F.col("pos")).alias("back"), F.col("own.letter").alias("letter"))).alias("x"))
    best = scratch.save(best.select("query_id", "rank", "similarity", "x.letter", "x.score"), "mapped")
    level = lambda levels, c: F.explode(F.array(*map(F.lit, levels))).alias(c)
    kept = best.select("*", level(option_levels, "option_level")).where("score >= option_level")
    weights = kept.groupBy("query_id", "option_level", "letter").agg(F.sum(F.greatest("similarity", F.lit(0.0)) * F.col("score")).alias("weight"))
    grid = scratch.save(raw.select("*", level(option_levels, "option_level")).select("*", level(vote_levels, "vote_level")), "grid")
    listed = weights.groupBy("query_id", "option_level").agg(F.collect_list(F.struct("weight", "letter")).alias("votes"), F.max("weight").alias("most"), F.max(F.struct("weight", "letter")).alias("first"))
    rows_ = grid.join(listed, ["query_id", "option_level"], "left")
    enough = F.filter(F.col("votes"), lambda v: (F.col("most") > 0) & (v["weight"] >= F.col("most") * F.col("vote_level")))
    several = F.array_join(F.array_sort(F.transform(enough, lambda v: v["letter"])), ",")
    said = F.coalesce(F.when(F.col("kind").isin("single", "bool"), F.col("first.letter")).otherwise(several), F.lit(""))
    rows_ = rows_.withColumn("completion", F.concat(F.lit("\\boxed{"), said, F.lit("}")))
    mapped = rows_.withColumn("mapped", grading.grade("expected_answer", "completion", T.boxed("completion")))
    each = kept.groupBy("query_id", "option_level", "rank").agg(F.array_join(F.array_sort(F.collect_set("letter")), ",").alias("said"))
    tried = pairs.select("query_id", "rank", "expected_answer", level(option_levels, "option_level")).join(each, ["query_id", "option_level", "rank"], "left")
    tried = tried.withColumn("completion", F.concat(F.lit("\\boxed{"), F.coalesce("said", F.lit("")), F.lit("}")))
    oracle = tried.groupBy("query_id", "option_level").agg(F.max(grading.grade("expected_answer", "completion", T.boxed("completion"))).alias("oracle"))
    out = mapped.join(oracle, ["query_id", "option_level"], "left").groupBy("option_level", "vote_level").agg(
        F.count("*").alias("samples"), F.avg("raw").alias("raw_reward"), F.avg("mapped").alias("mapped_reward"), F.avg(F.coalesce("oracle", F.lit(0.0))).alias("oracle_reward")
    )
    first = F.row_number().over(Window.orderBy(F.desc("mapped_reward"), "option_level", "vote_level")) == 1  # as many rows as settings
    return out.withColumn("gain", F.col("mapped_reward") - F.col("raw_reward")).withColumn("best", first)


# ---- with models ---------------------------------------------------------------------


def _ask(rows: DataFrame, fn: Callable[[pd.DataFrame], list], out: str, kind: str) -> DataFrame:
    """Rows with what a model says of each, called per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: list(fn(batch))})

    return rows.mapInPandas(run, rows.withColumn(out, F.lit(None).cast(kind)).schema)


def shortlist(s: Stages, parts: list[DataFrame], size: int) -> DataFrame:
    """(query_id, rank, source, text, score): lists in order, each (source,
    text) once, up to a size."""
    every = None
    for n, part in enumerate(parts):
        rows = part.withColumn("place", F.lit(n * 10_000) + F.col("rank"))
        every = rows if every is None else every.unionByName(rows)
    once = ranking.keep_first(every, ["query_id", "source", "text"], ["place"])
    return s.save(ranking.top_per_group(once.drop("rank"), ["query_id"], ["place"], size).drop("place").select("query_id", "rank", "source", "text", "score"), f"shortlist{len(parts)}")


def selected(s: Stages, short: DataFrame, fallback: DataFrame, select: Callable[[str, list[tuple[str, str]], int], str], k: int, chars: int = 220) -> tuple[DataFrame, DataFrame]:
    """(hits, replies): the model names candidates by number in its reply; what
    it leaves open is filled from the fallback in order."""
    shown = s.with_question(short)
    cut = rerank.snippets(shown.select("query_id", "rank", "source", "score", "question", "text"), chars).select("query_id", "rank", F.col("text").alias("shown"))
    listed = shown.join(cut, ["query_id", "rank"], "left").withColumn("shown", F.coalesce("shown", F.left("text", F.lit(chars))))
    asked = listed.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "shown"))).alias("listed"), F.count("*").alias("n"))

    def ask(batch: pd.DataFrame) -> list[str]:
        return [select(q, [(x["source"], x["shown"]) for x in c], k) for q, c in zip(batch["question"], batch["listed"])]

    replies = s.save(_ask(asked, ask, "reply", "string").withColumn("picked", T.rank_ids("reply", F.col("n"), k)).select("query_id", "reply", "picked"), "replies")
    chosen = replies.select("query_id", F.posexplode("picked").alias("place", "at")).join(short, (F.col("rank") == F.col("at") + 1) & (replies["query_id"] == short["query_id"])).select(replies["query_id"], F.col("place").alias("rank"), "source", "text", "score")
    return ranking.top_per_group(
        ranking.keep_first(chosen.withColumn("part", F.lit(0)).unionByName(fallback.withColumn("part", F.lit(1))), ["query_id", "source", "text"], ["part", "rank"]).withColumnRenamed("rank", "place"), ["query_id"], ["part", "place"], k
    ).select("query_id", "rank", "source", "text", "score"), replies


def candidate_rerank_report(index: retrieval.Index, rows: DataFrame, select: Callable, per_type: int = 16, seed: int = 42, options: Options = Options(), size: int = 18) -> dict[str, DataFrame]:
    """A model that picks from a shortlist, on held-out questions: ``means``
    of the default choice, the shortlist and the model's, and ``counters``."""
    s = stages(index, sample(questions_of(rows), per_type, seed, only_held_out=True), options)
    base = baseline(s)
    pool = s.save(s.with_texts(expanded_hits(s, candidate_hits(s))), "pool")
    default = s.save(s.reranked(pool, max(8, options.top_k), base), "default")
    strict = s.reranked(pool, max(8, options.top_k), base, WEIGHT_GRID["answer_role_strict"])
    short = shortlist(s, [default, pool.where("rank <= 8"), strict], max(options.top_k, size))
    hits, replies = selected(s, short, default, select, options.top_k)
    top = default.where(F.col("rank") <= options.top_k)
    counters = replies.agg(F.count("*").alias("samples"), F.coalesce(F.sum((F.size("picked") == 0).cast("long")), F.lit(0)).alias("empty_selections"), F.coalesce(F.avg(F.size("picked")), F.lit(0.0)).alias("mean_selected"))
    return {"means": means(stage_coverage(s, {"default_top3": top, "shortlist": short, "model_top3": s.save(hits, "model_hits")})), "counters": _long(counters)}


def rewrite_report(index: retrieval.Index, rows: DataFrame, rewrite: Callable[[str, int], str], select: Callable, per_type: int = 8, seed: int = 42, options: Options = Options(), size: int = 18) -> dict[str, DataFrame]:
    """A model that rewrites questions to search with, then picks: ``means``
    of eight stages, and ``counters``."""
    s = stages(index, sample(questions_of(rows), per_type, seed), options)
    base = baseline(s)
    raw = candidate_hits(s)
    raw_texts = s.save(s.with_texts(raw), "raw_texts")
    said = _ask(s.questions.select("query_id", "question"), lambda b: [rewrite(q, 3) for q in b["question"]], "reply", "string")
    said = s.save(said.withColumn("rewritten", T.query_list("reply", 3)), "rewrites")
    more = said.select("query_id", F.posexplode("rewritten").alias("place", "query")).select("query_id", (1000 + F.col("place")).alias("variant"), "query")
    found = candidate_hits(s, more)
    wide = expanded_hits(s, found)
    wide_texts = s.save(s.with_texts(wide), "wide_texts")
    short = s.save(s.reranked(wide_texts, max(options.top_k, size), base), "short")
    cut = s.save(s.snippets(wide_texts, 140), "cut")
    first = cut.where("rank = 1")
    packed = s.save(s.reranked(cut, 8, first), "packed8")
    hits, replies = selected(s, short, short, select, options.top_k)
    named = {
        "baseline_top3": s.save(s.reranked(raw_texts, options.top_k, base), "plain"), "baseline_pool": raw_texts, "rewrite_pool": s.save(s.with_texts(found), "found_texts"), "expanded_pool": wide_texts, "shortlist": short,
        "packed_top6": s.save(s.reranked(cut, 6, first), "packed6"), "packed_top8": packed, "model_top3": s.save(hits, "model_hits"),
    }
    measured = s.save(stage_coverage(s, named), "measured")
    wide_rows = by_stage(measured, stages_=[*named])
    avg = lambda c: F.avg(c)
    gaps = wide_rows.agg((avg("rewrite_pool") - avg("baseline_pool")).alias("rewrite_pool_gain"), (avg("model_top3") - avg("baseline_top3")).alias("gain_vs_baseline_top3"), (avg("expanded_pool") - avg("model_top3")).alias("final_selection_gap"))
    of = said.agg(F.count("*").alias("samples"), F.coalesce(F.sum((F.size("rewritten") == 0).cast("long")), F.lit(0)).alias("empty_rewrites"), F.coalesce(F.avg(F.size("rewritten")), F.lit(0.0)).alias("mean_rewrites"))
    return {"means": means(measured), "gaps": _long(gaps), "counters": _long(of), "replies": replies}


def binary_report(index: retrieval.Index, rows: DataFrame, judge: Callable[[str, str, str], float], per_type: int = 4, seed: int = 42, options: Options = Options(), size: int = 10) -> dict[str, DataFrame]:
    """A model that scores candidates one by one, on held-out questions:
    ordered by its score, then the reranker's, then place, two of a source."""
    s = stages(index, sample(questions_of(rows), per_type, seed, only_held_out=True), options)
    base = baseline(s)
    pool = s.save(s.with_texts(expanded_hits(s, candidate_hits(s))), "pool")
    short = s.save(s.reranked(pool, max(options.top_k, size), base), "short")
    asked = s.with_question(short).withColumn("shown", F.left("text", F.lit(260)))
    scored = s.save(_ask(asked, lambda b: [float(judge(*x)) for x in zip(b["question"], b["source"], b["shown"])], "judged", "double"), "scored")
    order = [F.desc("judged"), F.desc_nulls_last("score"), "place"]
    chosen = ranking.cap_with_refill(scored.withColumnRenamed("rank", "place"), ["query_id"], "source", order, options.top_k, 2).select("query_id", "rank", "source", "text", "score")
    counters = scored.agg(F.count("*").alias("scores"), F.coalesce(F.avg((F.col("judged") > 0.5).cast("double")), F.lit(0.0)).alias("positive_rate"))
    return {"means": means(stage_coverage(s, {"baseline_top3": base, "candidate_pool": pool, "binary_top3": s.save(chosen, "chosen")})), "counters": _long(counters)}


_SEARCH = re.compile(r"<search>\s*(.*?)\s*</search>", re.I | re.S)
_ANSWER = re.compile(r"<answer>.*?</answer>", re.I | re.S)


def teacher_report(index: retrieval.Index, rows: DataFrame, generate: Callable[[list[dict]], str], system: str = "", per_type: int = 4, seed: int = 42, options: Options = Options(structural=False, aligned=False), max_searches: int = 2, max_chars: int = 1200) -> dict[str, DataFrame]:
    """A model that searches and answers in turns: all episodes of a sample
    take a turn together, so that the searches of a turn are one search. A model
    that fails ends its episode with an error and without an answer."""
    s = stages(index, sample(questions_of(rows), per_type, seed, CLOSED_TYPES + OPEN_TYPES), options)
    start = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", F.concat(F.lit("题目："), F.col("question"))))))
    log = "array<struct<role:string,content:string>>"
    now = s.save(s.questions.select("query_id", "kind", "question", "expected_answer", start.cast(log).alias("log"), F.lit(0).alias("searches"), F.lit("").alias("final"), F.lit("").alias("asked"), F.lit(False).alias("failed"), F.lit(False).alias("over")), "turn0")

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                row["log"] = [dict(m) for m in row["log"]]
                if not row["over"]:
                    _teach(row, generate, max_searches)
                out.append(row)
            yield pd.DataFrame(out, columns=b.columns)

    for k in range(max_searches + 1):
        now = s.save(now.mapInPandas(turn, now.schema), f"said{k}")
        open_ = Stages(index, s.save(now.where("NOT over").select("query_id", "kind", F.col("question"), "expected_answer", F.concat("asked", F.lit("\n"), "question").alias("query"), "asked"), f"open{k}"), options, Scratch(index.chunks.sparkSession, "teacher"))
        if open_.questions.isEmpty():
            break
        views = T.query_variants("question", "asked") if options.query_expansion else F.array("query")
        variants = open_.questions.select("query_id", F.posexplode(views).alias("variant", "query"))
        hits = retrieval.search_union(index, variants, options.candidate_k, options.max_per_source)
        base = open_.save(open_.with_texts(retrieval.search(index, open_.questions.select("query_id", "query"), options.top_k, 2)), "base")
        best = open_.reranked(open_.with_texts(expanded_hits(open_, open_.save(hits, "hits"))), options.top_k, base)
        told = observation(best, open_.questions.select("query_id", "asked"), max_chars)
        seen = F.struct(F.lit("user").alias("role"), F.coalesce("told", F.lit("")).alias("content"))
        now = now.join(told, "query_id", "left").withColumn("log", F.when(F.col("over"), F.col("log")).otherwise(F.concat("log", F.array(seen)).cast(log))).drop("told")
        now = s.save(now, f"turn{k + 1}")
    graded = now.withColumn("reward", grading.grade("expected_answer", "final", T.boxed("final")))
    figures = [F.count("*").alias("samples"), F.avg("reward").alias("mean_reward"), F.avg((F.col("reward") >= 1).cast("double")).alias("perfect_rate"), F.sum((F.col("reward") < 0).cast("long")).alias("format_penalties"), F.avg("searches").alias("mean_searches"), F.sum(F.col("failed").cast("long")).alias("errors")]
    return {"by_type": graded.groupingSets([["kind"], []], "kind").agg(*figures), "episodes": graded.select("query_id", "kind", "final", "searches", "failed", "reward")}


def _teach(row: dict, generate: Callable[[list[dict]], str], max_searches: int) -> None:
    """One turn of one episode."""
    last = row["searches"] >= max_searches
    try:
        said = str(generate(row["log"])).strip()
        search = _SEARCH.search(said)
        if not (_ANSWER.search(said) or "\\boxed" in said and not search):
            if search and not last:
                row["log"].append({"role": "assistant", "content": said})
                row["asked"], row["searches"] = search[1].strip() or row["question"], row["searches"] + 1
                return
            row["log"] += [{"role": "assistant", "content": said}, {"role": "user", "content": "格式不完整。现在只输出最终 <answer>，必须包含 \\boxed{}，不要解释。"}]
            said = str(generate(row["log"])).strip()
        row["final"] = said
    except Exception:  # whatever a model behind a service raises
        row["failed"], row["final"] = True, ""
    row["over"] = True


def observation(hits: DataFrame, asked: DataFrame, max_chars: int) -> DataFrame:
    """(query_id, told): results as a model reads them, within a budget."""
    kept = ranking.char_budget(hits, ["query_id"], ["rank"], "text", max_chars)
    line = F.concat(F.lit("\n["), F.col("rank").cast("string"), F.lit("] 来源: "), T.safe_label("source"), F.lit("\n"), F.col("text"))
    lines = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    body = F.concat(F.lit('<search_results query="'), T.safe_label("asked"), F.lit('">'), F.coalesce("lines", F.lit("\n未找到匹配内容。")), F.lit("\n</search_results>"))
    return asked.join(lines, "query_id", "left").select("query_id", body.alias("told"))


# What a model may do next.
HINTS = {
    True: "已完成最后一次检索。下一轮不得再检索，必须直接给出最终答案；使用 answer XML 元素，并用 \\boxed 命令包裹本题真实答案。",
    False: "还可检索一次；若已有依据，请直接给出最终答案。最终答案必须使用 answer XML 元素和 \\boxed 命令，禁止填写占位词。",
}


def formatted(hits: DataFrame, asked: DataFrame, memory: DataFrame | None = None, max_chars: int = 1500, memory_chars: int = 900) -> DataFrame:
    """(query_id, told) for ``asked`` (query_id, asked, must_answer): results
    and, before them, similar training questions (query_id, rank, similarity,
    question, answer), each within its budget, and what to do next."""
    hint = F.when(F.col("must_answer"), HINTS[True]).otherwise(HINTS[False])
    head = F.concat(F.lit('<search_results query="'), T.safe_label("asked"), F.lit('">'))
    kept = ranking.char_budget(hits, ["query_id"], ["rank"], "text", max_chars)
    line = F.concat(F.lit("\n["), F.col("rank").cast("string"), F.lit("] 来源: "), T.safe_label("source"), F.lit("\n"), F.col("text"))
    joined = lambda df, c, out: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("line")))), lambda x: x["line"]), "").alias(out))
    out = asked.join(joined(kept.withColumn("line", line), "line", "lines"), "query_id", "left")
    if memory is None:
        out = out.withColumn("examples", F.lit(None).cast("string"))
    else:
        entry = F.concat(F.format_string("\n[相似题%d 相似度=%.3f]\n题目：", "rank", "similarity"), "question", F.lit("\n训练集标准答案："), "answer", F.lit("\n"))
        entries = ranking.char_budget(memory.withColumn("entry", entry), ["query_id"], ["rank"], "entry", memory_chars)
        out = out.join(joined(entries, "entry", "examples"), "query_id", "left")
    intro = "\n<memory_examples>\n以下仅为相似训练题参考；当前题选项可能不同，必须按当前题语义重新映射，不能机械复制字母。"
    examples = F.when(F.col("examples").isNotNull(), F.concat(F.lit(intro), "examples", F.lit("</memory_examples>"))).otherwise("")
    nothing = F.col("lines").isNull() & F.col("examples").isNull()
    told = F.when(nothing, F.concat(head, F.lit("\n未找到匹配内容。\n</search_results>\n"), hint)).otherwise(F.concat(head, examples, F.coalesce("lines", F.lit("")), F.lit("\n</search_results>\n"), hint))
    return out.select("query_id", told.alias("told"))


# ---- cold start ------------------------------------------------------------------------


def cold_start(index: retrieval.Index, rows: DataFrame, prompt: Callable[[Column], Column], target_open: int, target_closed: int, scan_open: int, scan_closed: int, least: float = 0.0, seed: int = 42, top_k: int = 3, max_chars: int = 1500, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(trajectories, scanned) for training: each question once, in the order
    of its hash, of each type the first that a search finds evidence for (open
    types) and whose own answer is graded in full, up to the type's target among
    the first ones scanned. Trajectories have messages: prompt, search, what it
    finds, and the answer."""
    scratch = Scratch(rows.sparkSession, "coldstart")
    from ..plans import datasets

    targets = ranking.quotas(target_open, list(OPEN_TYPES)) | ranking.quotas(target_closed, list(CLOSED_TYPES))
    scan = {k: scan_open for k in OPEN_TYPES} | {k: scan_closed for k in CLOSED_TYPES}
    keyed = rows.withColumns({"kind": T.question_type("query"), "group_key": datasets.question_key("query")}).where(F.col("group_key") != "")
    once = ranking.keep_first(keyed, ["kind", "group_key"], [order]).where(F.col("kind").isin(*scan))
    ranked = ranking.top_per_group(once, ["kind"], [ranking.hash_order(seed, F.col(order)), order], max(scan.values()), "scan_rank")
    pick = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    scanned = scratch.save(ranked.where(F.col("scan_rank") <= pick(scan)).withColumn("asked", T.deterministic_query("query")), "scanned")
    asked = scanned.select(F.col(order).alias("query_id"), F.concat("asked", F.lit("\n"), T.question_text("query")).alias("query"))
    hits = retrieval.search(index, asked, top_k, 2)
    texts = scratch.save(retrieval.small(hits).join(index.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "source", "text"), "texts")
    told = formatted(texts, scanned.select(F.col(order).alias("query_id"), "asked", F.lit(False).alias("must_answer")), max_chars=max_chars)
    found = scanned.join(evaluation.passages(texts, ["query_id"]).withColumnRenamed("query_id", order), order, "left").join(told.withColumnRenamed("query_id", order), order)
    found = evaluation.progress_coverage(found.withColumns({"passage": F.coalesce("passage", F.lit("")), "question": T.question_text("query")}), "question", "expected_answer", "passage", "evidence")
    answer = F.concat(F.lit("<answer>根据题目与检索结果，\\boxed{"), T.answer_payload("expected_answer"), F.lit("}</answer>"))
    found = scratch.save(found.withColumn("answer", answer).withColumn("reward", grading.grade("expected_answer", "answer", T.boxed("answer"))), "graded")
    open_ = F.col("kind").isin(*OPEN_TYPES)
    good = (F.col("reward") == 1.0) & (T.expected_type("expected_answer") == F.col("kind")) & (~open_ | (F.col("evidence") > 0) & (F.col("evidence") + 1e-9 >= max(0.0, least)))
    taken = ranking.top_per_group(found.where(good), ["kind"], ["scan_rank"], max([1, *targets.values()]), "pick_rank").where(F.col("pick_rank") <= pick(targets))
    search = F.concat(F.lit("<search>"), "asked", F.lit("</search>"))
    said = (("user", prompt(F.col("query"))), ("assistant", search), ("environment", F.col("told")), ("assistant", F.col("answer")))
    messages = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said))
    out = taken.select(F.col(order).alias("query_id"), "kind", F.when(open_, "open").otherwise("closed").alias("category"), "group_key", "evidence", "scan_rank", messages.alias("messages"))
    return scratch.save(out, "trajectories"), found


def cold_start_statistics(trajectories: DataFrame, scanned: DataFrame) -> DataFrame:
    """(kind, scanned, selected, mean_evidence, median_evidence, full,
    three_quarters): of open types, the evidence found; kind null for all."""
    scans = scanned.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("scanned"))
    e = F.when(F.col("category") == "open", F.col("evidence"))
    of = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    picks = trajectories.groupingSets([["kind"], []], "kind").agg(
        F.count("*").alias("selected"), F.coalesce(F.avg(e), F.lit(0.0)).alias("mean_evidence"), F.coalesce(F.median(e), F.lit(0.0)).alias("median_evidence"), of(e >= 1 - 1e-9).alias("full"), of(e >= 0.75).alias("three_quarters")
    )
    joined = scans.join(picks.withColumnRenamed("kind", "k"), F.col("kind").eqNullSafe(F.col("k")), "left").drop("k")
    return joined.select("kind", "scanned", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("selected", "mean_evidence", "median_evidence", "full", "three_quarters")))
