"""Workbooks, question banks, plug-ins and streams of telemetry."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import grading
from lexmill.functions import text as T
from lexmill.plans import banks, config, datasets, plugins, runs
from lexmill.sources import files, workbooks
from lexmill.streaming import telemetry

NONE = [None] * 11
CHOICE = [["notice"], banks.HEADERS["单选题"], [None, None, None, *banks.LABELS["单选题"]]]
BOOK = {
    "单选题": [*CHOICE, [1, "What etches?", "A", "fluorine", "argon", *[None] * 10, "gas|etch", "难", "because"], [2, "Lost?", None, "x"], [3, "Beyond?", "D", "x", "y"], [4, "（示例）no", "A", "x"]],
    "判断题": [banks.HEADERS["判断题"], [1, "It is so", "true", "kp", None, None], [2, "Which A. one B. two", "对"], [3, "Odd", "?"], [1, "It is so", "true", "kp", None, None]],
    "填空题": [["notice"], banks.HEADERS["填空题"], [None, None, *banks.LABELS["填空题"]], [1, "Fill __", "one", None, "three"], [2, "Empty __"]],
    "简答题": [["nothing here"], ["at all"]],
    "other": [["x"]],
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "20260611160325_bank.xlsx").write_bytes(workbooks.workbook([(k, iter(v)) for k, v in BOOK.items()]))
    (folder / "plain.xlsx").write_bytes(workbooks.workbook([("Sheet1", iter([["a", 1.5, 3]]))]))
    (folder / "broken.xlsx").write_bytes(b"no zip")
    (folder / "~$open.xlsx").write_bytes(b"lock")
    grid = workbooks.read_workbooks(spark, f"file://{folder}").cache()
    return grid, banks.standardize(grid)


def test_cells(found):
    grid, _ = found
    assert {r.file for r in grid.collect()} == {"20260611160325_bank.xlsx", "plain.xlsx", "broken.xlsx"}
    assert grid.where("file = 'plain.xlsx'").first().cells == ["a", "1.5", "3"]
    assert "BadZipFile" in grid.where("file = 'broken.xlsx'").first().error


def test_standardized_banks(found):
    _, out = found
    rows = {(r.qtype, r.number): r for r in out["questions"].collect()}
    assert set(rows) == {("单选题", 1), ("判断题", 1), ("填空题", 1)}
    one = rows["单选题", 1]
    assert (one.answer, one.options[:3], one.knowledge_points, one.difficulty, one.explanation, one.row_num) == ("A", ["fluorine", "argon", ""], "gas|etch", "难", "because", 4)
    assert (rows["判断题", 1].answer, rows["判断题", 1].difficulty, rows["填空题", 1].answer) == ("对", "简单", "one|three")
    reasons = {r.reason: r.n for r in out["reasons"].collect()}
    assert reasons == {"missing_answer": 3, "answer_out_of_range": 1, "looks_like_mixed_choice": 1, "missing_header": 1, "duplicate": 1}
    reports = {r.file: r for r in out["files"].collect()}
    assert {k: (r.status, r.questions) for k, r in reports.items()} == {"20260611160325_bank.xlsx": ("ok", 4), "plain.xlsx": ("not_question_bank", 0), "broken.xlsx": ("error", 0)}
    assert reports["plain.xlsx"].issues == ["sheets=Sheet1"] and reports["20260611160325_bank.xlsx"].issues[:2] == ["单选题:row5:missing_answer", "单选题:row6:answer_out_of_range"]


def test_sinks(spark, found, tmp_path):
    _, out = found
    questions = out["questions"]
    banks.write_merged(questions, f"file://{tmp_path}/merged.xlsx")
    again = banks.standardize(workbooks.read_workbooks(spark, f"file://{tmp_path}"))["questions"]
    key = lambda df: sorted((r.qtype, r.number, r.question, r.answer, tuple(r.options)) for r in df.collect())
    assert key(again) == key(questions)
    banks.write_corpus(questions, f"file://{tmp_path}/corpus", "T", "2026-01-01 00:00:00")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/corpus/all_questions").collect())
    assert text.startswith("# T\n\n生成时间: 2026-01-01 00:00:00\n题目总数: 3\n\n## [单选题] What etches?\n\n- 来源文件: bank\n- 来源Sheet: 单选题\n- 难度: 难\n- 知识点: gas|etch\n\n### 选项\n- A. fluorine\n- B. argon\n\n**正确答案**: A\n\n**解析**: because\n")
    assert "### 填空答案\n- 空1: one\n- 空3: three" in text
    flat = spark.read.option("header", "true").csv(f"file://{tmp_path}/corpus/csv").collect()
    assert [r["题型"] for r in sorted(flat, key=lambda r: (datasets.SHEETS.index(r["题型"]), int(r["序号"])))] == ["单选题", "判断题", "填空题"] and len(flat[0]) == 20
    banks.write_report(out, f"file://{tmp_path}/report", "now")
    told = json.loads((tmp_path / "report/processing_report.json").read_text())
    assert told["summary"]["questions_by_type"]["单选题"] == 1 and told["summary"]["files_included"] == 1
    assert "- bank: 4 题" in (tmp_path / "report/processing_report.md").read_text()


def test_synonym_table(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "groups": [["Big", "large "], ["x/y", ""]]}))
    table = files.read_synonyms(spark, f"file://{tmp_path}/s.json")
    groups = files.synonym_groups(table)
    assert groups == [["big", "large"], ["xy"]]
    frame = spark.createDataFrame([("[fill] big", "\\boxed{LARGE}")], "e string, c string")
    assert frame.select(grading.grade("e", "c", T.boxed("c"), groups=groups).alias("r")).first().r == 1.0


def test_rewards_and_prompts_by_name(spark):
    frame = spark.createDataFrame([("q", "\\boxed{B}", "[single] B"), ("q", "no", "[single] B")], "query string, completion string, expected_answer string")
    assert [r.reward for r in plugins.with_reward(frame, "rules").collect()] == [1.0, -0.5]
    plugins.reward("lengths", batched=True)(lambda q, c, e: [len(x) for x in c])
    assert [r.reward for r in plugins.with_reward(frame, "lengths").collect()] == [9.0, 2.0]
    plugins.reward("short", batched=True)(lambda q, c, e: [])
    with pytest.raises(Exception, match="0 numbers"):
        plugins.with_reward(frame, "short").collect()
    with pytest.raises(KeyError):
        plugins.with_reward(frame, "unknown")
    plugins.prompt("loud", per_text=True)(str.upper)
    assert frame.select(plugins.rendered(F.col("query"), "loud").alias("p")).first().p == "Q"
    assert frame.select(plugins.rendered(F.col("query"), "plain").alias("p")).first().p == "q"


def test_retries_and_fan_out(spark):
    tried, waits = [], []

    def send(rows):
        tried.append(rows)
        if len(tried) < 3:
            raise OSError("down")

    telemetry.with_retries(send, 3, waits.append)([{"a": 1}])
    assert len(tried) == 3 and waits == [1.0, 2.0]
    tried.clear()
    with pytest.raises(OSError):
        telemetry.with_retries(send, 2, waits.append)([])
    nodes = spark.createDataFrame([("n1",), ("n22",)], "node_id string")
    got = {r.node_id: r.metrics for r in telemetry.node_snapshots(nodes, lambda n: {"size": len(n), "none": None}, tasks=2).collect()}
    assert got == {"n1": {"size": 2.0}, "n22": {"size": 3.0}}


def test_flattened_json_of_any_depth(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "l": [1, [2, {"x": None}]], "s": "{no json", "empty": {}, "none": []}
    frame = spark.createDataFrame([(0, json.dumps(deep)), (1, None)], "i int, j string")
    got = {r.i: r.m for r in frame.select("i", config.flatten_json(F.col("j")).alias("m")).collect()}
    assert got[1] is None
    assert {k: v for k, v in got[0].items() if k != "s"} == {"a.b.c.d.e.f": "1", "l[0]": "1", "l[1][0]": "2", "l[1][1].x": "null"}


def test_actors_fall_back_to_this_node(spark):
    actors = spark.createDataFrame([("j1", "n1", 5, "ALIVE"), ("j2", "n2", 6, "DEAD")], "job_id string, node_id string, pid int, state string")
    got = {r.job_id: r for r in runs.alive(actors, jobs=actors.select("job_id"), here="me").collect()}
    assert (got["j1"].node_ids, got["j2"].node_ids, got["j2"].pids) == (["n1"], ["me"], None)
