import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluation, ranking, rerank, retrieval
from lexmill.plans import config, datasets, runs
from lexmill.sources import files
from lexmill.streaming import episodes, telemetry


def test_merge_and_flatten():
    base = {"a": {"x": 1, "y": 2}, "b": {"k": 1}}
    assert config.merge(base, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": {"k": 1}}
    assert config.merge(base, {"b": {"_override_": True, "n": 2}})["b"] == {"n": 2}
    assert config.flatten({"a": {"b": 1, "c": [10, 20]}, "d": None}) == {"a.b": "1", "a.c[0]": "10", "a.c[1]": "20", "d": "null"}


def test_inheritance(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"p": {"q": 1, "r": 2}}))
    (tmp_path / "top.json").write_text(json.dumps({"defaults": "base.json", "p": {"r": 3}}))
    assert config.resolve(tmp_path / "top.json", json.loads) == {"p": {"q": 1, "r": 3}}


def test_config_rules(spark):
    conf = lambda batch: {"grpo.num_prompts_per_step": "4", "grpo.num_generations_per_prompt": "4", "policy.train_global_batch_size": batch}
    rows = spark.createDataFrame([("ok", conf("16")), ("bad", conf("12")), ("skip", conf("${x}"))], "name string, conf map<string,string>")
    assert [(r.name, r.rule) for r in config.violations(rows).collect()] == [("bad", "batch_product")]


def test_data_path(spark):
    rows = spark.createDataFrame([("${oc.env:QA_RL_DATA_DIR}/t.jsonl",), ("/x",), ("${OTHER}/y",), ("z",)], "raw string")
    assert [r.p for r in rows.select(config.data_path(F.col("raw"), "/r").alias("p")).collect()] == ["/r/datasets/qa_rl/t.jsonl", "/x", None, "/r/z"]


def test_direct_splits(spark):
    row = lambda i, q, e: (i, f"一道单选题\n题目：{q}", e)
    data = [row(i, f"question {i}", "[single] A") for i in range(80)] + [row(80, "question 0", "[single] A"), row(81, "question 1", "[single] B"), (82, "一道填空题\n题目：odd", "[single] A")]
    out = datasets.direct_splits(spark.createDataFrame(data, "ord int, query string, expected_answer string"), denominator=5).collect()
    status = pd.Series([r.status for r in out]).value_counts().to_dict()
    assert status == {"ok": 79, "conflict": 1, "invalid": 1}
    sides = {s: {r.group_key for r in out if r.split == s} for s in ("train", "validation")}
    assert sides["train"] and sides["validation"] and not sides["train"] & sides["validation"]


def test_direct_splits_keep_forms_of_several_lines(spark):
    data = [(0, "一道填空题\n题目：first", "[fill] two.\nlines/other ||| a;b ||| 2"), (1, "一道填空题\n题目：second", "[fill] ||| b"), (2, "一道简答题\n题目：third", "[short] two;\nlines ||| b")]
    splits = datasets.direct_splits(spark.createDataFrame(data, "ord int, query string, expected_answer string"), denominator=5).cache()
    out = {r.group_key: r for r in splits.collect()}
    assert {k: r.status for k, r in out.items()} == {"first": "ok", "second": "invalid", "third": "ok"}
    assert out["first"].completion == "<answer>\\boxed{two. lines; a b; 2}</answer>"
    assert out["third"].completion == "<answer>\\boxed{two;\nlines; b}</answer>"


def test_split_statistics_count_forms_of_several_lines_as_kept(spark):
    data = [(0, "一道填空题\n题目：first", "[fill] two.\nlines/other ||| a ||| 2"), (1, "一道填空题\n题目：second", "[fill] ||| b")]
    splits = datasets.direct_splits(spark.createDataFrame(data, "ord int, query string, expected_answer string"), denominator=5)
    found = datasets.split_statistics(splits).first()
    assert (found.questions, found.kept, found.invalid, found.conflicts) == (2, 1, 1, 0)


def test_direct_splits_show_the_first_form_that_is_read(spark):
    data = [(0, "一道填空题\n题目：first", "[fill] /b ||| ./c;d ||| 2"), (1, "一道简答题\n题目：second", "[short] . ||| /b"), (2, "一道填空题\n题目：third", "[fill] ./ ||| b")]
    splits = datasets.direct_splits(spark.createDataFrame(data, "ord int, query string, expected_answer string"), denominator=5)
    out = {r.group_key: (r.status, r.completion) for r in splits.collect()}
    assert out["first"] == ("ok", "<answer>\\boxed{b; c d; 2}</answer>")
    assert out["second"] == ("ok", "<answer>\\boxed{.; b}</answer>")
    assert out["third"][0] == "invalid"


def test_types_are_checked(spark):
    rows = spark.createDataFrame([("一道填空题",)], "query string")
    with pytest.raises(ValueError):
        datasets.filter_types(rows, ["essay"])
    with pytest.raises(ValueError):
        datasets.filter_types(rows, ["single"])
    assert datasets.filter_types(rows, []).count() == 1


def test_trajectories(spark):
    data = [(i, "fill" if i % 2 else "single", f"题目：q{i % 6}", float(i % 3) / 2, 1.0 if i != 4 else 0.0) for i in range(12)]
    rows = spark.createDataFrame(data, "ord int, kind string, query string, covered double, reward double")
    out = datasets.trajectories(rows, "covered", "reward", ["ord"], {"fill": 10, "single": 10}, {"fill": 1, "single": 1}, 0.5).collect()
    assert sorted((r.kind, r.ord) for r in out) == [("fill", 1), ("single", 0)]


def test_group_split(spark):
    rows = spark.createDataFrame([("c", f"k{i % 4}", i) for i in range(8)], "category string, k string, i int")
    out = ranking.group_split(rows, "category", "k", 0.5).collect()
    sides = {s: {r.k for r in out if r.split == s} for s in ("train", "validation")}
    assert len(sides["train"]) == len(sides["validation"]) == 2 and not sides["train"] & sides["validation"]


def test_high_low(spark):
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate([0.1, 0.9, 0.2, 0.8])], "g int, i int, r double")
    picked = lambda k: sorted(x.i for x in ranking.high_low(rows, ["g"], "r", "i", k).collect())
    assert picked(2) == [0, 1]
    assert picked(1) == [0]
    assert picked(9) == [0, 1, 2, 3]


def test_checkpoints(spark):
    dirs = spark.createDataFrame([("r", "step_5"), ("r", "step_12"), ("r", "step_x")], "root string, dir string")
    assert runs.latest_checkpoint(dirs).first().dir == "step_12"
    assert runs.latest_checkpoint(dirs, wanted=5).first().dir == "step_5"
    assert runs.backend(spark.createDataFrame([("r", "iter_0000001"), ("s", "x")], "root string, entry string")).orderBy("root").first().backend == "megatron"


def test_diagnostics(spark):
    rows = spark.createDataFrame(list(zip([0.0, 0.0, 0.0, 1.0, 0.5], [1, 1, 2, 2, 3], ["fill", "fill", "short", "short", "single"])), "reward double, prompt int, kind string")
    by = {r.kind: r for r in evaluation.type_diagnostics(rows).collect()}
    assert len(by) == 5 and by["fill"].zero_rate == 1 and by["short"].mean_reward == 0.5 and by["bool"].n == 0
    got = evaluation.group_variance(rows, "prompt").first()
    assert (got.n_groups, got.zero_variance_rate, got.effective_rate) == (2, 0.5, 0.5)
    assert evaluation.group_variance(rows.where("false"), "prompt").first().effective_rate == 0
    assert evaluation.reward_summary(rows.where("false")).count() == 0


def _index(spark, docs, **options):
    return retrieval.build_index(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(docs)], "chunk_id long, source string, text string"), **options)


def test_search_and_structure(spark):
    docs = [("部门/process.md", "离子注入系统由离子源、分析磁场组成"), ("部门/process.md", "加速器说明"), ("部门/other.md", "清洗流程"), ("部门/设备培训-试卷.md", "设备通过【1】连接"), ("部门/设备培训-答案.md", "数据总线 设备")]
    index = _index(spark, docs)
    asked = spark.createDataFrame([(1, "离子注入系统组成")], "query_id long, query string")
    hits = retrieval.search(index, asked)
    assert hits.orderBy("rank").first().source == "部门/process.md"
    assert {r.chunk_id for r in retrieval.neighbours(index, hits).collect()} >= {1}
    exam = spark.createDataFrame([(1, 1, 3, "部门/设备培训-试卷.md", 10)], "query_id long, rank int, chunk_id long, source string, score_e9 long")
    query = spark.createDataFrame([(1, "设备通过什么连接")], "query_id long, query string")
    assert 4 in {r.chunk_id for r in retrieval.expand(index, query, exam).collect()}


def test_aliases(spark):
    index = _index(spark, [("litho.md", "photolithography process"), ("etch.md", "plasma etching")], expand_ascii=True)
    asked = spark.createDataFrame([(1, "photoresist process")], "query_id long, query string")
    assert retrieval.search(index, asked).orderBy("rank").first().source == "litho.md"


def test_rerank_prefers_evidence(spark):
    question = "SERVER ROOM 通过【1】与Clean room进行连接"
    hits = [(1, question, 1, "考试/试卷.md", "一、填空题\n1. SERVER ROOM 通过与Clean room进行连接", 100.0), (1, question, 2, "手册.md", "SERVER ROOM 通过数据总线与Clean room进行连接", 80.0)]
    rows = spark.createDataFrame(hits, "query_id long, question string, rank int, source string, text string, score double")
    assert rerank.rerank(rows, 2).orderBy("pick").first().source == "手册.md"
    with pytest.raises(ValueError):
        rerank.weighted(rerank.features(rows), (1.0,))
    short = rerank.snippets(rows.where("rank = 2"), 80).first().text
    assert len(short) <= 80 and "数据总线" in short


def test_ridge(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.0, 1.0), ("a", 0.1, 1.0, 0.0), ("b", 0.8, 0.1, 1.0), ("b", 0.2, 0.9, 0.0)], "g string, x double, y double, label double")
    model = rerank.fit_ridge(rows, "g", "label", ("x", "y"), 0.01)
    p = {r.label: r.prediction for r in rerank.predict_ridge(rows.where("g = 'a'"), model, ("x", "y")).collect()}
    assert p[1.0] > p[0.0]


def test_markdown(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.md").write_text("intro\n\n# Title\nline a\nline b\n\nlast\n", encoding="utf-8")
    (tmp_path / "two.txt").write_text("no")
    read = files.read_markdown(spark, str(tmp_path))
    assert [r.source for r in read.collect()] == ["d/one.md"]
    blocks = files.markdown_blocks(read)
    assert [r.body for r in blocks.orderBy("block").collect()] == ["[one]\nintro", "[Title]\nline a\nline b", "[Title]\nlast"]
    assert [r.text for r in files.pack_blocks(blocks).collect()] == ["[one]\nintro\n\n[Title]\nline a\nline b\n\n[Title]\nlast"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"query": "题"}\n\n{"query": "b"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "query string")
    assert [r.query for r in rows.orderBy("ord").collect()] == ["题", "b"]
    files.write_jsonl(rows.select("query"), str(tmp_path / "out"), 1)
    assert "题" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    with pytest.raises(Exception, match="lacks"):
        datasets.required(spark.createDataFrame([("",)], "query string"), ["query"]).collect()


def test_sse(spark):
    lines = ["event: log", "id: 1", "data: line A", "data:     缩进的 line B", "data:", "", ": ping", "", "event: end", "data: x"]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, line_no int, line string")
    out = files.sse_events(rows).orderBy("event_no").collect()
    assert [(r.event, r.event_id, r.data) for r in out] == [("log", "1", "line A\n    缩进的 line B\n"), ("end", "1", "x")]


def test_episode_rules():
    s = episodes.State()
    assert episodes.step(s, False, True, 0, 0, False) == ("search", 0.0) and s.searches == 1 and not s.must_answer
    assert episodes.step(s, False, True, 0, 0, False)[0] == "search" and s.must_answer
    assert episodes.step(s, False, True, 0, 0, False)[0] == "correction"
    assert episodes.step(s, False, False, 0, 0, False) == ("format_error", -0.5) and s.ended
    shaped = episodes.State(evidence=1.0)
    assert episodes.step(shaped, True, False, 0.0, 0, True, scale=0.1) == ("answer", 0.1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, t == 3, t < 3, 1.0, 0.5, True) for c in range(4) for t in range(1, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, boxed boolean, searching boolean, reward double, found double, shaped boolean")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = episodes.run_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 2, 0.1, idle=None)
    q = stream.writeStream.format("memory").queryName("episode_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    order = ["conv_id", "turn"]
    assert spark.table("episode_test").orderBy(*order).collect() == episodes.run_batch(turns, 2, 0.1).orderBy(*order).collect()


def test_sink_keeps_failures(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(5)], "v long")
    rows.write.parquet(str(tmp_path / "in"))

    def refuse(group):
        raise OSError("no route")

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    telemetry.start_sink(stream, refuse, str(tmp_path / "dead"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "dead")).count() == 5


def test_intervals(spark):
    n = spark.createDataFrame([(x,) for x in (0, 9, 10, 49, 50, 200)], "n int")
    assert [r.i for r in n.select(telemetry.sampling_interval(F.col("n")).alias("i")).collect()] == [10, 10, 30, 30, 60, 60]
    assert [r.i for r in n.limit(1).select(telemetry.sampling_interval(F.col("n"), 20, False).alias("i")).collect()] == [20]


def test_bank(spark):
    data = [(1, "单选题", "q1", "b", ["x", "y"]), (2, "单选题", "q1", "B", ["x", "y"]), (3, "单选题", "q2", "", ["x"]), (4, "多选题", "q3", "AE", ["x", "y"]), (5, "判断题", "（示例", "对", [""]), (6, "判断题", "q4", "错", [""])]
    good, bad = datasets.standardize_bank(spark.createDataFrame(data, "ord int, qtype string, raw_question string, raw_answer string, raw_options array<string>"))
    assert sorted((r.ord, r.answer, r.number) for r in good.collect()) == [(1, "B", 1), (6, "错", 1)]
    assert {r.reason: r.n for r in datasets.reject_reasons(bad).collect()} == {"missing_answer": 1, "answer_out_of_range": 1}
    assert {r.reason for r in datasets.reject_reasons(bad, strict=True).collect()} == {"row3:missing_answer", "row4:answer_out_of_range"}
