"""Reports, memory, models and cold start, on tables small enough to follow by hand."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import reports, retrieval

TEXTS = [
    (0, "fab/etch-manual.md", "Plasma etching removes silicon with fluorine. The pressure is 30 mTorr."),
    (1, "fab/etch-manual.md", "The chamber contains a turbo pump and a throttle valve."),
    (2, "fab/etch-exam.md", "Plasma etching removes ____ with ____. 填空题"),
    (3, "fab/litho-manual.md", "Photoresist is developed in alkaline solution after exposure."),
    (4, "fab/litho-manual.md", "The wavelength of the scanner is 193 nm."),
    (5, "fab/doping.md", "Ion implantation consists of acceleration and a mass filter."),
]
ROWS = [
    (1, "一道填空题\n题目：Plasma etching removes ____ with ____", "[fill] silicon ||| fluorine"),
    (2, "一道简答题\n题目：What does the etch chamber contain", "[short] turbo pump ||| throttle valve/gate valve"),
    (3, "一道填空题\n题目：Photoresist is developed in ____", "[fill] alkaline solution"),
    (4, "一道简答题\n题目：Of what does ion implantation consist", "[short] acceleration ||| mass filter"),
    (5, "一道单选题\n题目：Which wavelength has the scanner\n\n选项：A. 193 nm B. 248 nm", "[single] A"),
    (6, "一道判断题\n题目：The scanner works at 193 nm", "[bool] A"),
]


@pytest.fixture(scope="module")
def index(spark):
    return retrieval.build_index(spark.createDataFrame(TEXTS, "chunk_id long, source string, text string"))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "ord long, query string, expected_answer string")


def compact(t):
    return re.sub(r"[\W_]", "", t.lower())


def plain_coverage(expected, hits):
    items = [[compact(a) for a in re.split("[/／]", i) if compact(a)] for i in re.sub(r"^\s*\[\w+\]\s*", "", expected).split("|||")]
    passage = "\n".join(f"{s}\n{t}" for s, t in hits)
    tokens = set(re.findall(r"[a-z0-9][a-z0-9_.+-]*", passage.lower()))
    found = [any(len(a) >= 2 and a in compact(passage) or a.isdigit() and a in tokens for a in i) for i in items if i]
    return sum(found) / len(found) if found else 0.0


def figures(df):
    return {r["name"]: r["value"] for r in df.collect()}


def test_stage_coverage(spark, index, rows):
    s = reports.stages(index, reports.questions_of(rows), reports.Options(top_k=2))
    base = reports.baseline(s)
    pool = s.save(s.with_texts(reports.expanded_hits(s, reports.candidate_hits(s))), "pool")
    got = {(r.query_id, r.stage): r for r in reports.stage_coverage(s, {"base": base, "pool": pool}).collect()}
    hits = {}
    for name, df in (("base", base), ("pool", pool)):
        for r in df.orderBy("rank").collect():
            hits.setdefault((r.query_id, name), []).append((r.source, r.text))
    assert len(got) == 2 * len(ROWS)
    for i, _, expected in ROWS:
        for name in ("base", "pool"):
            found = hits.get((i, name), [])
            r = got[i, name]
            assert (r.coverage, r.n, r.chars) == (pytest.approx(plain_coverage(expected, found)), len(found), sum(len(t) for _, t in found))
    assert got[1, "pool"].coverage == 1 and got[1, "pool"].copy_rate > 0  # the exam repeats the question


def test_retrieval_ab(index, rows):
    out = reports.retrieval_ab(index, rows, 10, options=reports.Options(candidate_k=5))
    means = {(r.kind, r.stage): r.coverage for r in out["funnel"].collect()}
    stages = {s for _, s in means}
    assert stages == {"corpus", "baseline_top3", "candidate_pool", "expanded_pool", "snippet_pool", "packed", "reranked_top3"}
    assert means[None, "corpus"] == 1 and means[None, "expanded_pool"] >= means[None, "candidate_pool"]
    gaps, counters = figures(out["gaps"]), figures(out["counters"])
    for name, a, b in reports.GAPS:
        assert gaps[name] == pytest.approx(means[None, b] - means[None, a])
    assert counters["samples"] == 4 and counters["improved"] + counters["regressed"] <= 4
    report = {(r.kind, r.fold): r for r in out["reranker"].collect()}
    assert report[None, None]["count"] == 4 and len(out["model"]["weights"]) == 11


def test_weight_grid_and_expansion(index, rows):
    grid = {(r.kind, r.stage): r for r in reports.weight_grid(index, rows, 10, options=reports.Options(candidate_k=5)).collect()}
    assert {s for _, s in grid} == {"baseline", *reports.WEIGHT_GRID}
    for (kind, _), r in grid.items():
        assert r.gain == pytest.approx(r.coverage - grid[kind, "baseline"].coverage)
    more = rows.unionByName(rows.where("ord < 5").select((F.col("ord") + 100).alias("ord"), F.regexp_replace("query", "etch", "dry etch").alias("query"), "expected_answer"))
    questions = reports.questions_of(more)
    held = {r.query_id for r in questions.where(reports.held_out(F.col("group_key"))).collect()}
    open_held = {i for i in held if i % 100 < 5}
    if open_held:
        out = reports.expansion_report(index, more, reports.Options(candidate_k=5), least=0.1)
        assert figures(out["counters"])["samples"] == len(open_held)


def test_memory_and_options(spark):
    ask = "一道单选题\n题目：{} number {}\n\n选项：A. {} B. {}".format
    listed = [(i, ask("Which gas is used for the etching of oxide", i, *(("argon", "fluorine") if i % 2 else ("fluorine", "argon"))), f"[single] {'B' if i % 2 else 'A'}") for i in range(30)]
    frame = spark.createDataFrame(listed, "ord long, query string, expected_answer string")
    held = {r.query_id for r in reports.questions_of(frame).where(reports.held_out(F.col("group_key"))).collect()}
    assert 0 < len(held) < 30
    best = [r for r in reports.option_report(frame).collect() if r.best]
    assert len(best) == 1 and best[0].samples == len(held) and best[0].mapped_reward == 1.0 and best[0].oracle_reward == 1.0
    assert best[0].raw_reward < 1.0 and best[0].gain == pytest.approx(1 - best[0].raw_reward)
    memory = {r.kind: r for r in reports.memory_report(frame)["by_type"].collect()}
    assert memory[None].samples == len(held) and memory["single"].top1_reward == pytest.approx(best[0].raw_reward)
    again = frame.unionByName(frame.withColumn("ord", F.col("ord") + 100))
    entries = reports.memory_entries(again, ("single",))
    assert entries.count() == 30  # each question and answer once
    near = reports.memory_search(entries, entries.select(F.col("train_id").alias("query_id"), "kind", "text"), 2, 0.15)
    assert all(r.train_id == r.query_id and r.similarity == pytest.approx(1) for r in near.where("rank = 1").collect())


def held_rows(spark):
    """Open questions that are held out, by trying wordings."""
    out = []
    for k in range(60):
        out.append((k, f"一道填空题\n题目：Plasma etching number {k} removes ____ with", "[fill] silicon"))
        out.append((100 + k, f"一道简答题\n题目：What contains the chamber number {k}", "[short] turbo pump"))
    return spark.createDataFrame(out, "ord long, query string, expected_answer string")


def test_reports_with_models(spark, index, rows):
    questions = held_rows(spark)

    def select(question, candidates, limit):
        return "the best is " + " ".join(str(k + 1) for k, (_, t) in enumerate(candidates) if "pump" in t or "silicon" in t)

    out = reports.candidate_rerank_report(index, questions, select, 3, options=reports.Options(candidate_k=5))
    means, counters = {(r.kind, r.stage): r.coverage for r in out["means"].collect()}, figures(out["counters"])
    assert means[None, "model_top3"] == 1.0 == means[None, "shortlist"] and counters["samples"] == 6 and counters["empty_selections"] == 0
    none = reports.candidate_rerank_report(index, questions, lambda q, c, k: "none of them", 3, options=reports.Options(candidate_k=5))
    means = {(r.kind, r.stage): r.coverage for r in none["means"].collect()}
    assert figures(none["counters"])["empty_selections"] == 6 and means[None, "model_top3"] == means[None, "default_top3"]

    out = reports.binary_report(index, questions, lambda q, s, t: 0.9 if "pump" in t or "silicon" in t else 0.1, 2, options=reports.Options(candidate_k=5))
    means = {(r.kind, r.stage): r.coverage for r in out["means"].collect()}
    assert means[None, "binary_top3"] == 1.0 and 0 < figures(out["counters"])["positive_rate"] < 1

    out = reports.rewrite_report(index, rows, lambda q, n: '["turbo pump", "mass filter acceleration"]' if "what" in q.lower() else "", select, 4, options=reports.Options(candidate_k=5))
    means = {(r.kind, r.stage): r.coverage for r in out["means"].collect()}
    assert {s for _, s in means} == {"baseline_top3", "baseline_pool", "rewrite_pool", "expanded_pool", "shortlist", "packed_top6", "packed_top8", "model_top3"}
    assert figures(out["counters"])["empty_rewrites"] == 2 and means[None, "rewrite_pool"] >= means[None, "baseline_pool"]


def test_teacher(index, rows):
    def generate(messages):
        said = [m["content"] for m in messages if m["role"] == "user"]
        question = said[0]
        if "scanner works" in question:
            raise RuntimeError("out of service")
        if "wavelength" in question:
            return "<answer>\\boxed{A}</answer>" if len(said) > 1 else "I wonder"
        if len(said) == 1:
            return "<search>etching removes</search>"
        return "<answer>\\boxed{silicon; fluorine}</answer>" if "silicon" in said[1] else "<search>again</search>" if len(said) < 4 else "\\boxed{x}"

    out = reports.teacher_report(index, rows, generate, options=reports.Options(candidate_k=5, structural=False))
    got = {r.query_id: r for r in out["episodes"].collect()}
    assert (got[1].reward, got[1].searches, got[6].failed, got[6].reward) == (1.0, 1, True, -0.5)
    assert got[5].reward == 1.0 and got[5].searches == 0
    total = {r.kind: r for r in out["by_type"].collect()}[None]
    assert total.samples == 6 and total.errors == 1 and total.format_penalties >= 1


def test_cold_start(index, rows):
    again = rows.unionByName(rows.where("ord = 1").withColumn("ord", F.lit(50).cast("long")))
    taken, scanned = reports.cold_start(index, again, lambda q: F.concat(F.lit("ask: "), q), 4, 3, 10, 10)
    got = {r.query_id: r for r in taken.collect()}
    assert scanned.count() == 6 and 1 in got and 50 not in got
    assert all(r.evidence > 0 for r in got.values() if r.category == "open")
    said = got[1].messages
    assert [m.role for m in said] == ["user", "assistant", "environment", "assistant"]
    assert said[0].content.startswith("ask: 一道填空题") and said[1].content.startswith("<search>") and "来源: fab/" in said[2].content and said[3].content.endswith("\\boxed{silicon; fluorine}</answer>")
    stats = {r.kind: r for r in reports.cold_start_statistics(taken, scanned).collect()}
    assert stats[None].scanned == 6 and stats[None].selected == len(got) and stats["fill"].full == sum(r.kind == "fill" and r.evidence >= 1 for r in got.values())


def test_formatted_results(spark):
    hits = spark.createDataFrame([(1, 1, "a<b.md", "x" * 30), (1, 2, "c.md", "y" * 30), (1, 3, "d.md", "z")], "query_id long, rank int, source string, text string")
    asked = spark.createDataFrame([(1, "find <x>", False), (2, "none", True), (3, "like", True)], "query_id long, asked string, must_answer boolean")
    memory = spark.createDataFrame([(3, 1, 0.5, "old question", "B")], "query_id long, rank int, similarity double, question string, answer string")
    got = {r.query_id: r.told for r in reports.formatted(hits, asked, memory, max_chars=40).collect()}
    assert got[1] == '<search_results query="find ＜x＞">\n[1] 来源: a＜b.md\n' + "x" * 30 + "\n[2] 来源: c.md\n" + "y" * 10 + "\n</search_results>\n" + reports.HINTS[False]
    assert got[2] == '<search_results query="none">\n未找到匹配内容。\n</search_results>\n' + reports.HINTS[True]
    assert "[相似题1 相似度=0.500]\n题目：old question\n训练集标准答案：B\n</memory_examples>" in got[3]


def test_queries_and_options_by_hand(spark):
    frame = spark.createDataFrame([("一道单选题\n题目：Which _x\n\n选项：A. one  two\nB、three C) four",), ("no options",)], "q string")
    got = [[(o.letter, o.text) for o in r.o] for r in frame.select(T.options("q").alias("o")).collect()]
    assert got == [[("A", "one two"), ("B", "three"), ("C", "four")], []]
    assert frame.select(T.deterministic_query(F.lit("题目：使用____的工艺")).alias("q")).first().q == "的工艺"
