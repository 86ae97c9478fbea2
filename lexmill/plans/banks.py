"""Question banks: from the sheets of workbooks to questions, and out again."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as sources
from ..sources import workbooks
from . import datasets

# The sheets' notices, headers and labels.
CHOICES = ("单选题", "多选题")
HEADERS = {
    "单选题": ["序号（必填）", "题目(必填)", "正确答案(必填)", "选项", *[None] * 11, "知识点", "难度*(必填)", "答案解析"],
    "判断题": ["序号（必填）", "题目(必填)", "正确答案(必填)", "知识点", "难度*(必填)", "答案解析"],
    "填空题": ["序号（必填）", "题目(必填)", "填空项"],
    "简答题": ["序号（必填）", "题目(必填)", "关键词"],
}
HEADERS["多选题"] = HEADERS["单选题"]
LABELS = {
    "单选题": ["A", "B", "C", "D", *(f"{c}(勿删)" for c in "EFGHIJKL")], "填空题": [f"空{k}" for k in range(1, 11)], "简答题": [f"关键词{k}" for k in range(1, 11)],
}
LABELS["多选题"] = LABELS["单选题"]
OPTION_COUNT = {"单选题": 12, "多选题": 12, "填空题": 10, "简答题": 10}
EASY = "简单"


def parse_grids(grid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, issues, files) of workbooks' cells (file, sheet, row_num,
    cells, error): sound rows of the standard sheets; (file, issue) lines of
    what was left out; and of each file its status, issues and questions."""
    standard = F.col("sheet").isin(datasets.SHEETS)
    heads = datasets.header_rows(grid.where(standard & F.col("row_num").isNotNull()))
    find = lambda *names: datasets.column_index(F.col("headers"), list(names))
    start = F.when(F.col("sheet").isin(*CHOICES), F.coalesce(find("选项"), F.lit(3))).when(F.col("sheet") == "填空题", F.coalesce(find("填空项"), F.lit(2))).otherwise(F.coalesce(find("关键词"), F.lit(2)))
    needs_answer = F.col("sheet").isin(*CHOICES, "判断题")
    placed = heads.select("file", "sheet", "header_row", find("题目").alias("q"), find("正确答案", "答案").alias("a"), start.alias("start"), find("知识点").alias("kp"), find("难度").alias("diff"), find("答案解析", "解析").alias("exp"))
    placed = placed.withColumn("bad", F.col("q").isNull() | (needs_answer & F.col("a").isNull()))
    sheets = grid.where(standard).select("file", "sheet").distinct()
    headless = sheets.join(placed, ["file", "sheet"], "left").where(F.col("header_row").isNull() | F.col("bad"))
    headless = headless.select("file", "sheet", F.lit(0).alias("row_num"), F.when(F.col("header_row").isNull(), "missing_header").otherwise("bad_header").alias("issue"))

    skip = F.when(F.col("sheet") == "判断题", 1).otherwise(2)
    rows = grid.where(standard).join(placed.where("NOT bad"), ["file", "sheet"]).where(F.col("row_num") >= F.col("header_row") + skip)
    cell = lambda at: T.clean_cell(F.get("cells", F.col(at)))
    padded = F.when(F.col("sheet").isin(*CHOICES), datasets.padded(F.col("cells"), F.col("start"), 12)).when(F.col("sheet").isin("填空题", "简答题"), datasets.padded(F.col("cells"), F.col("start"), 10)).otherwise(F.array().cast("array<string>"))
    read = rows.select(
        "file", F.col("sheet").alias("qtype"), "row_num", cell("q").alias("raw_question"), cell("a").alias("raw_answer"), padded.alias("raw_options"), T.knowledge_points(cell("kp")).alias("knowledge_points"),
        F.coalesce(F.nullif(cell("diff"), F.lit("")), F.lit(EASY)).alias("difficulty"), F.when(F.col("sheet").isin("填空题", "简答题"), "").otherwise(F.coalesce(cell("exp"), F.lit(""))).alias("explanation"),
    )
    marked = datasets.bank_questions(read)
    columns = ["qtype", "question", "answer", "options", "knowledge_points", "difficulty", "explanation", F.col("file").alias("source_file"), F.col("qtype").alias("source_sheet"), "row_num"]
    questions = marked.where("issue IS NULL").select(*columns)
    rejected = marked.where("issue IS NOT NULL").select("file", F.col("qtype").alias("sheet"), "row_num", "issue")
    line = F.when(F.col("issue").isin("missing_header", "bad_header"), F.col("issue")).otherwise(F.concat_ws(":", "sheet", F.concat(F.lit("row"), F.col("row_num")), "issue"))
    issues = headless.unionByName(rejected).select("file", "sheet", "row_num", "issue", line.alias("line"))
    return questions, issues, file_reports(grid, questions, issues)


def file_reports(grid: DataFrame, questions: DataFrame, issues: DataFrame) -> DataFrame:
    """(file, status, issues, questions) of every file that was scanned."""
    seen = grid.groupBy("file").agg(F.max("error").alias("error"), F.array_sort(F.collect_set("sheet")).alias("sheets"))
    counts = questions.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, datasets.SHEETS)), F.col("sheet"))
    told = issues.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "row_num", "line"))), lambda x: x["line"]).alias("lines"))
    out = seen.join(counts, "file", "left").join(told, "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bank = datasets.is_bank(F.col("sheets"))
    status = F.when(F.col("error").isNotNull(), "error").when(~bank, "not_question_bank").when(F.col("n") == 0, "empty_or_invalid").otherwise("ok")
    lines = F.when(F.col("error").isNotNull(), F.array("error")).when(~bank, F.array(F.concat(F.lit("sheets="), F.array_join(F.slice("sheets", 1, 5), ",")))).otherwise(F.coalesce("lines", F.array().cast("array<string>")))
    return out.select("file", status.alias("status"), lines.alias("issues"), F.col("n").alias("questions"))


def standardize(grid: DataFrame, keep_duplicates: bool = False) -> dict[str, DataFrame]:
    """questions (each once, numbered per type), reasons (with the number of
    duplicates) and files of workbooks' cells."""
    found, issues, files = parse_grids(grid)
    order = F.struct("source_file", F.array_position(F.array(*map(F.lit, datasets.SHEETS)), F.col("qtype")), "row_num")
    ordered = found.withColumn("ord", order)
    once = ordered if keep_duplicates else datasets.once(ordered, "ord")
    reasons = issues.groupBy(F.col("issue").alias("reason")).agg(F.count("*").alias("n"))
    if not keep_duplicates:
        gone = ordered.agg(F.count("*").alias("a")).crossJoin(once.agg(F.count("*").alias("b"))).select(F.lit("duplicate").alias("reason"), (F.col("a") - F.col("b")).alias("n"))  # single rows
        reasons = reasons.unionByName(gone)
    return {"questions": datasets.numbered(once, "ord").drop("ord"), "reasons": reasons, "files": files}


def markdown(with_title: Column | None = None) -> Column:
    """A question (columns of :func:`standardize`) as a section for a retrieval corpus."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    q, kp, exp = F.col("qtype"), F.col("knowledge_points"), F.col("explanation")
    none = F.array().cast("array<string>")
    numbered = lambda name: F.filter(F.transform("options", lambda o, k: F.when(o != "", text(f"- {name}", (k + 1).cast("string"), ": ", o))), lambda x: x.isNotNull())
    lettered = F.filter(F.transform("options", lambda o, k: F.when(o != "", text("- ", F.char(F.lit(65) + k), ". ", o))), lambda x: x.isNotNull())
    title = T.source_title("source_file") if with_title is None else with_title
    lines = F.concat(
        F.array(text("## [", q, "] ", F.col("question")), F.lit(""), text("- 来源文件: ", title), text("- 来源Sheet: ", F.col("source_sheet")), text("- 难度: ", F.col("difficulty"))),
        F.when(F.coalesce(kp, F.lit("")) != "", F.array(text("- 知识点: ", kp))).otherwise(none),
        F.when(q.isin(*CHOICES), F.concat(F.array(F.lit(""), F.lit("### 选项")), lettered))
        .when(q == "填空题", F.concat(F.array(F.lit(""), F.lit("### 填空答案")), numbered("空")))
        .when(q == "简答题", F.concat(F.array(F.lit(""), F.lit("### 参考答案关键词")), numbered("关键词")))
        .otherwise(none),
        F.array(F.lit(""), text("**正确答案**: ", F.col("answer")), F.lit("")),
        F.when(F.coalesce(exp, F.lit("")) != "", F.array(text("**解析**: ", exp), F.lit(""))).otherwise(none),
    )
    return F.array_join(lines, "\n")


def in_order(questions: DataFrame) -> DataFrame:
    return questions.withColumn("place", F.array_position(F.array(*map(F.lit, datasets.SHEETS)), F.col("qtype"))).orderBy("place", "number").drop("place")


def write_merged(questions: DataFrame, path: str) -> None:
    """One workbook with a sheet per type: notice, headers, labels, numbered
    questions. The format bounds its rows; they are streamed to the driver."""

    def rows(kind: str) -> Iterator[list]:
        yield [f"{kind}说明（说明部分请勿删除）"]
        yield HEADERS[kind]
        first = 3 if kind in CHOICES else 2
        if kind in LABELS:
            yield [*[None] * first, *LABELS[kind]]
        for r in questions.where(F.col("qtype") == kind).orderBy("number").toLocalIterator():
            options = [*r.options, *[None] * OPTION_COUNT.get(kind, 0)][: OPTION_COUNT.get(kind, 0)]
            tail = [r.knowledge_points, r.difficulty or EASY, r.explanation]
            yield [int(r.number), r.question, *([r.answer, *options, *tail] if kind in CHOICES else [r.answer, *tail] if kind == "判断题" else options)]

    workbooks.write_file(questions.sparkSession, path, workbooks.workbook([(kind, rows(kind)) for kind in datasets.SHEETS]))


def write_corpus(questions: DataFrame, path: str, title: str = "题库", now: str | None = None) -> None:
    """Under the path: ``all_questions`` (Markdown in order), ``by_source`` (a
    folder of Markdown per source), ``jsonl`` with rag_text, ``csv`` with twelve
    option columns."""
    stamp = now or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    spark = questions.sparkSession
    rows = questions.withColumn("source_title", T.source_title("source_file")).withColumn("rag_text", markdown())
    head = "\n".join([f"# {title}", "", f"生成时间: {stamp}", f"题目总数: {questions.count()}", ""])
    place = F.array_position(F.array(*map(F.lit, datasets.SHEETS)), F.col("qtype"))
    lines = rows.select(place.alias("p"), F.col("number").cast("long").alias("n"), F.col("rag_text").alias("value"))
    first = spark.createDataFrame([(0, 0, head)], "p long, n long, value string")
    first.unionByName(lines).orderBy("p", "n").select("value").write.mode("overwrite").text(f"{path}/all_questions")
    counted = rows.groupBy("source_title").agg(F.count("*").alias("k")).select("source_title", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("# "), "source_title", F.lit("\n\n题目数量: "), F.col("k").cast("string"), F.lit("\n")).alias("value"))
    each = counted.unionByName(rows.select("source_title", place.alias("p"), F.col("number").cast("long").alias("n"), F.col("rag_text").alias("value")))
    safe = sources.safe_name(F.col("source_title"))
    each.withColumn("source", safe).repartition("source").sortWithinPartitions("source", "p", "n").select("source", "value").write.mode("overwrite").partitionBy("source").text(f"{path}/by_source")
    sources.write_jsonl(rows, f"{path}/jsonl")
    names = ["题型", "题目", "正确答案", *(f"选项{c}" for c in "ABCDEFGHIJKL"), "知识点", "难度", "来源文件", "来源Sheet"]
    columns = ["qtype", "question", "answer", *(F.coalesce(F.get("options", k), F.lit("")) for k in range(12)), "knowledge_points", "difficulty", "source_title", "source_sheet"]
    flat = rows.select(place.alias("p"), "number", *((F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names)))
    flat.orderBy("p", "number").drop("p").withColumnRenamed("number", "序号").write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def report(found: dict[str, DataFrame], now: str | None = None) -> tuple[str, str]:
    """(Markdown, JSON) on what :func:`standardize` found: counts by type,
    reasons by frequency, files in and out. Files and reasons are few."""
    kinds = {r.qtype: r.n for r in found["questions"].groupBy("qtype").agg(F.count("*").alias("n")).collect()}
    reasons = [(r.reason, r.n) for r in found["reasons"].orderBy(F.desc("n"), "reason").collect()]
    files = [r.asDict() for r in found["files"].orderBy("file").collect()]
    inside, out = [f for f in files if f["questions"]], [f for f in files if not f["questions"]]
    title = lambda name: name.removeprefix("20260611160325_").removesuffix(".xlsx").removesuffix(".xls")
    lines = ["# 题库标准化处理报告", "", f"生成时间: {now or datetime.now().strftime('%Y-%m-%d %H:%M:%S')}", "", "## 汇总", "", f"- 扫描文件数: {len(files)}", f"- 有效题库文件: {len(inside)}", f"- 排除文件: {len(out)}", "", "## 题型统计", ""]
    lines += [f"- {kind}: {kinds.get(kind, 0)}" for kind in datasets.SHEETS] + ["", "## 剔除原因统计", ""] + [f"- {r}: {n}" for r, n in reasons]
    lines += ["", "## 已纳入题库文件", ""] + [f"- {title(f['file'])}: {f['questions']} 题" for f in sorted(inside, key=lambda f: -f["questions"])]
    lines += ["", "## 排除文件", ""] + [f"- [{f['status']}] {f['file']} {'; '.join(f['issues'][:2])}" for f in sorted(out, key=lambda f: f["status"])]
    summary = {"files_scanned": len(files), "files_included": len(inside), "files_excluded": len(out), "questions_by_type": {k: kinds.get(k, 0) for k in datasets.SHEETS}, "rejected_reasons": dict(reasons)}
    return "\n".join(lines), json.dumps({"summary": summary, "files": files}, ensure_ascii=False, indent=2)


def write_report(found: dict[str, DataFrame], path: str, now: str | None = None) -> None:
    spark = found["files"].sparkSession
    for name, text in zip(("processing_report.md", "processing_report.json"), report(found, now)):
        workbooks.write_file(spark, f"{path}/{name}", text.encode())
