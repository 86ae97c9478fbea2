import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import grading, udfs
from lexmill.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (0,)], [*(values or {"x": 0})])
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "expected, completion, want",
    [
        ("[single] B", "答案 \\boxed{B}", 1.0), ("[single] B", "\\boxed{C}", 0.0), ("[single] B", "我觉得是 B", -0.5), ("[bool] A", "\\boxed{A}", 1.0),
        ("[multiple] A,C,D", "\\boxed{D, A, C}", 1.0), ("[multiple] A,C,D", "\\boxed{A,C}", 2 / 3), ("[multiple] A,C,D", "\\boxed{A,B,C,D}", 2.5 / 3),
        ("[fill] 拒收/reject ||| 特采/waive ||| 放行/Release", "\\boxed{reject; 特采; Release}", 1.0), ("[fill] 正向 ||| 3V ||| 0V ||| 0.7V", "\\boxed{正向; 3V; 1V; 0.7V}", 0.75),
        ("[short] 低温/掺杂 ||| 纯度高 ||| 横向扩散小", "离子注入是低温工艺，纯度高。\\boxed{低温; 纯度高}", 2 / 3), ("plain answer", "\\boxed{Plain, answer}", 1.0), ("[fill] wafer", "\\boxed{硅片}", 1.0),
    ],
)
def test_grade(spark, expected, completion, want):
    frame = spark.createDataFrame([(expected, completion)], "e string, c string")
    assert frame.select(grading.grade("e", "c", T.boxed("c")).alias("r")).first().r == pytest.approx(want)


BOXES = [
    (r"\boxed{a_{1} + b}", "a_{1} + b"), (r"\boxed{A} 再想想 \boxed{C}", "C"), ("none", None), (r"\boxed{open", None), (r"\boxed{x{y}} and \boxed{open {", "x{y}"),
    (r"\boxed {a{b{c{d{e}}}}}", "a{b{c{d{e}}}}"), (r"\boxed{a \boxed{in}}", "in"), (r"\boxed{ok} \boxed{a{", "ok"), (r"\boxed{}", ""), (r"\boxed{{}}}", "{}"), (None, None),
]


def test_balanced_boxes(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOXES)], "i int, t string")
    got = {r.i: r.b for r in frame.select("i", T.boxed("t").alias("b")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(BOXES)}


def test_compatibility_forms(spark):
    frame = spark.createDataFrame([("ＡＢＣ１２３　ﬁne ①㎏ Ｘ．Ｙ",), ("plain",), (None,)], "t string")
    got = [tuple(r) for r in frame.select(T.normalize("t"), T.compact("t"), T.terms("t")).collect()]
    assert got[0] == ("abc123 fine 1kg x.y", "abc123fine1kgxy", ["abc123", "fine", "1kg", "x.y"])
    assert got[1][0] == "plain" and got[2][0] is None


def test_terms(spark):
    assert one(spark, T.terms("s"), s="SiC-200 离子注入 a") == ["sic-200", "a", "离子", "子注", "注入", "离子注入"]
    assert one(spark, T.terms("s", True), s="SiC-200") == ["sic-200", "sic", "200"]
    assert one(spark, T.terms("s"), s="中") == ["中"]
    assert one(spark, T.terms("s"), s="") == []


def test_families(spark):
    key = lambda p: one(spark, T.family_key("s"), s=p)
    assert key("部门/设备培训-试卷.md") == key("部门/设备培训-答案.md") == "部门/设备培训"
    assert key("a/答案.md") == ""


def test_answer_notation(spark):
    e = "[fill] 数据总线/bus ||| 洁净室/cleanroom"
    assert one(spark, T.answer_payload("s"), s=e) == "数据总线; 洁净室"
    assert one(spark, T.gold_items("s"), s=e) == [["数据总线", "bus"], ["洁净室", "cleanroom"]]
    assert one(spark, T.question_text("s"), s="说明\n题目：多少？\n\n选项：A. 1") == "多少？"
    assert one(spark, T.question_type("s"), s="这是一道填空题") == "fill"
    assert one(spark, T.number_answer("s"), s="so #### 1,234") == "1234"


def test_model_outputs(spark):
    assert one(spark, T.rank_ids("s", 4, 3), s="[3, 1, 3, 99]") == [2, 0]
    assert one(spark, T.query_list("s", 3), s='["GC-MS 检测规范", "<search>操作 要求</search>", "gc-ms检测规范"]') == ["GC-MS 检测规范", "操作 要求"]
    assert one(spark, T.query_list("s", 3), s="- one\n2. two\n\none") == ["one", "two"]


def test_variants(spark):
    assert one(spark, T.query_variants("s"), s="设备通过【1】连接洁净室 GC-MS") == ["设备通过【1】连接洁净室 GC-MS", "gc ms", "设备通过", "连接洁净室 GC-MS", "连接洁净室"]


def test_copy_and_bridge(spark):
    question, exam, manual = "SERVER ROOM 通过【1】与Clean room进行连接", "一、填空题\n1. SERVER ROOM 通过（ ）与Clean room进行连接", "SERVER ROOM 通过数据总线与Clean room进行连接"
    assert udfs.bridge(question, exam) == -1.0
    assert udfs.bridge(question, manual) == 1.0
    assert udfs.bridge("no blanks", manual) == 0.0
    score = lambda text: one(spark, T.copy_score("q", "t", F.lit(udfs.bridge(question, text))), q=question, t=text)
    assert score(exam) == 1.0
    assert score(manual) == 0.0


def test_log_lines(spark):
    line = lambda s: one(spark, T.log_line("s", "2025-01-02 03:04:05"), s=s)
    assert line("\u001b[32mhello\u001b[0m") == "2025-01-02 03:04:05 hello"
    assert line("(Worker pid=12, ip=10.0.0.1) INFO 06-07 08:09:10 ready") == "2025-06-07 08:09:10 INFO ready"
    assert line("2024-01-01 00:00:00 kept") == "2024-01-01 00:00:00 kept"


def test_small_formats(spark):
    assert one(spark, T.human_bytes("s"), s=1023) == "1023 B"
    assert one(spark, T.human_bytes("s"), s=6081741) == "5.8 MB"
    assert one(spark, T.elapsed("s"), s=65.0) == "1m 05s"
    assert one(spark, T.clean_cell("s"), s=" a ​b \n c") == "a b c"
    assert one(spark, T.judge_answer("s"), s=" True") == "对"
    assert one(spark, T.choice_answer("s"), s="b, a") == "BA"
    assert one(spark, T.choice_answer("s"), s="x") is None
    assert one(spark, T.safe_label("s"), s="<a>") == "＜a＞"
    assert one(spark, T.windows("s", 10, 2), s="abcdefghijklmnop") == ["abcdefghij", "ijklmnop"]


def test_windows_of_long_texts_are_cut_in_one_pass(spark):
    texts = ["né 文。x\n" * 900 + "end  ", "  " + "word " * 80_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = df.select(T.snippet_windows("t", 140).alias("s"), T.windows("t", 480).alias("w")).collect()
    assert time.time() - began < 20  # minutes while each window stripped the whole text anew
    for t, r in zip(texts, got):
        fixed = [x for i in range(0, len(t.strip()), 70) if (x := t.strip()[i:i + 140].strip())]
        assert r.s[-len(fixed):] == fixed
        assert r.w == [x for k in range(-(-(len(t) - 480) // 400) + 1) if (x := t[k * 400:k * 400 + 480].strip())]
