"""Measures of retrieval, answers and episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from . import ranking

TYPES = [name for name, _ in T.TYPE_MARKERS]
STEADY = 1e-8


def form_found(form: Column, compact_passage: Column, tokens: Column) -> Column:
    number = form.rlike("^[0-9]+$") & F.array_contains(tokens, form)
    return ((F.length(form) >= 2) & F.contains(compact_passage, form)) | number


def covered_items(items: Column, compact_passage: Column, tokens: Column) -> Column:
    return T.share(F.filter(items, lambda item: F.exists(item, lambda form: form_found(form, compact_passage, tokens))), items)


def evidence_coverage(rows: DataFrame, expected: str, passage: str, out: str) -> DataFrame:
    """Adds the share of the answer's items that the passage holds."""
    return rows.withColumn(out, covered_items(T.gold_items(expected), T.compact(passage), T.ascii_tokens(passage)))


def progress_coverage(rows: DataFrame, question: str, expected: str, passage: str, out: str) -> DataFrame:
    """The same for open types, without forms that the question has already."""
    asked = T.compact(question)
    novel = F.filter(F.transform(T.gold_items(expected), lambda item: F.filter(item, lambda form: ~F.contains(asked, form))), lambda item: F.size(item) > 0)
    words = F.regexp_extract_all(T.normalize(passage), F.lit("[a-z0-9]+"), F.lit(0))
    share = covered_items(novel, T.compact(passage), words)
    return rows.withColumn(out, F.when(T.expected_type(expected).isin("fill", "short"), share).otherwise(0.0))


def passages(hits: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """The texts of each group's hits, with their sources, joined in order."""
    line = F.concat("source", F.lit("\n"), "text")
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    return hits.groupBy(*keys).agg(F.array_join(sorted_lines, "\n").alias("passage"))


#: Forms that one automaton holds, about; more are searched for in further passes.
FORM_BLOCK = 100_000


def gold_presence(golds: DataFrame, texts: DataFrame, form: str = "form", text: str = "passage") -> DataFrame:
    """The distinct forms that any text holds: numbers as words, others of two
    characters and more anywhere in its letters and digits. Numbers are joined
    with the texts' words; the others make an automaton that every text is run
    through once. Texts never meet forms in pairs."""
    forms = golds.select(F.col(form).alias("form")).where("form IS NOT NULL").distinct()
    number = F.col("form").rlike("^[0-9]+$")
    said = texts.select(F.explode(F.filter(T.ascii_tokens(text), lambda t: t.rlike("^[0-9]+$"))).alias("form"))
    out = forms.where(number).join(said, "form", "left_semi")
    strings = forms.where(~number & (F.length("form") >= 2))
    n_blocks = max(1, -(-strings.count() // FORM_BLOCK))
    compact = texts.select(T.compact(text).alias("c"))
    for k in range(n_blocks):
        part = strings.where(F.pmod(F.xxhash64("form"), F.lit(n_blocks)) == k)
        out = out.unionByName(_held(compact, [r.form for r in part.toLocalIterator()]))  # about FORM_BLOCK forms
    return out.withColumnRenamed("form", form)


def _held(texts: DataFrame, forms: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for x in forms:
            trie.add_word(x, x)
        trie.make_automaton()
        seen: set[str] = set()
        for batch in batches if forms else ():
            new = {x for t in batch.column(0).to_pylist() if t for _, x in trie.iter(t)} - seen
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["form"])

    return texts.mapInArrow(run, "form string").distinct()


def type_diagnostics(rows: DataFrame, kind: str = "kind", reward: str = "reward") -> DataFrame:
    """(kind, n, mean_reward, zero_rate) for each of the types, found or not."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(t,) for t in TYPES], "kind string")
    found = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.avg(reward).alias("mean_reward"), F.avg((F.col(reward) == 0).cast("double")).alias("zero_rate"))
    return F.broadcast(every).join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_reward", "zero_rate")))


def group_variance(rows: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """One row: groups of several samples, how many do not vary, the rest."""
    groups = rows.groupBy(group).agg(F.count("*").alias("n"), (F.max(reward) - F.min(reward)).alias("spread")).where("n > 1")
    flat = F.coalesce(F.avg((F.col("spread") <= STEADY).cast("double")), F.lit(0.0))
    return groups.agg(F.count("*").alias("n_groups"), flat.alias("zero_variance_rate"), F.when(F.count("*") > 0, 1.0 - flat).otherwise(0.0).alias("effective_rate"))


def reward_summary(rows: DataFrame, reward: str = "reward") -> DataFrame:
    """One row of means; none for no rewards."""
    mean = lambda c: F.avg(c.cast("double"))
    r = F.col(reward)
    out = rows.agg(F.count("*").alias("n"), mean(r).alias("mean_reward"), mean(r >= 1).alias("perfect_rate"), mean(r < 0).alias("format_penalty_rate"))
    return out.where("n > 0")


def search_summary(messages: DataFrame, conv: str = "conv_id", role: str = "role", content: str = "text") -> DataFrame:
    """One row: how often conversations search and answer."""
    mine = F.col(role) == "assistant"
    searched, boxed = mine & F.col(content).rlike(r"(?is)<search>.*?</search>"), mine & F.col(content).rlike(r"\\boxed\s*\{")
    per = messages.groupBy(conv).agg(F.sum(searched.cast("int")).alias("searches"), F.max(boxed.cast("int")).alias("answered"))
    avg = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per.agg(F.count("*").alias("n"), avg((F.col("searches") > 0).cast("double")).alias("search_rate"), avg("searches").alias("average_searches"), avg("answered").alias("final_answer_rate"))


def stage_funnel(rows: DataFrame, stages: list[str], kind: str = "kind") -> DataFrame:
    """(kind, stage, n, coverage): mean coverage by stage, of each type and of
    all (kind null), in one pass of grouping sets."""
    long = rows.select(F.col(kind).alias("kind"), F.explode(F.create_map(*(x for s in stages for x in (F.lit(s), F.col(s))))).alias("stage", "value"))
    return long.groupingSets([["kind", "stage"], ["stage"]], "kind", "stage").agg(F.count("*").alias("n"), F.avg("value").alias("coverage"))


def vote(neighbours: DataFrame, query: str, answer: str, weight: str) -> DataFrame:
    """The answer with the largest sum of weights; of equals the larger."""
    sums = neighbours.groupBy(query, answer).agg(F.sum(F.greatest(F.col(weight), F.lit(0))).alias("weight"))
    return sums.groupBy(query).agg(F.max(F.struct("weight", answer)).alias("x")).select(query, F.col(f"x.{answer}").alias(answer), "x.weight")


def confidence_table(rows: DataFrame, confidence: str, reward: str, levels: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """(level, n, coverage, mean_reward) of rows at or above each level, in one
    pass: each row is counted at the levels it reaches."""
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("total"))  # one row
    reached = rows.select(F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: F.col(confidence) >= x)).alias("level"), F.col(reward).alias("r"))
    sums = reached.groupBy("level").agg(F.count("*").alias("n"), F.avg("r").alias("mean_reward"))
    every = F.broadcast(spark.createDataFrame([(x,) for x in levels], "level double"))
    out = every.join(sums, "level", "left").crossJoin(F.broadcast(total))
    return out.select("level", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("coverage"), F.coalesce("mean_reward", F.lit(0.0)).alias("mean_reward"))


def map_options(pairs: DataFrame, keys: list[str], options: str, target: str = "answer", least: float = 0.7) -> DataFrame:
    """For each row's answer text the likest of its options, the first of
    equals, if it is like enough: keys, letter, similarity."""
    every = pairs.select(*keys, target, F.posexplode(options).alias("pos", "option"))
    scored = every.withColumn("similarity", udfs.option_similarity(target, "option"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("similarity", (-F.col("pos")).alias("back"))).alias("x"))
    return best.where(F.col("x.similarity") >= least).select(*keys, F.char(F.lit(65) - F.col("x.back")).alias("letter"), "x.similarity")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def judge_with_fallback(rows: DataFrame, scores: DataFrame, key: str, rule: str, eligible: str) -> DataFrame:
    """Adds reward and its source: the judge's score, held to 0..1, where it
    was asked and answered; else the rule's grade."""
    joined = rows.join(scores.select(key, F.col("score").alias("_judge")), key, "left")
    judged = F.col(eligible) & F.col("_judge").isNotNull()
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_judge")))
    source = F.when(judged, "judge").when(F.col(eligible), "fallback").otherwise("rule")
    return joined.withColumn("reward", F.when(judged, held).otherwise(F.col(rule))).withColumn("reward_source", source).drop("_judge")


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return ranking.keep_first(rows, keys, order)


def scalar(values: Column) -> Column:
    """The mean of an array's numbers; null for none."""
    numbers = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
