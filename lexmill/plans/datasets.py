"""Training-set construction: validation, merging, conflicts, splits, banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grading
from ..functions import text as T
from ..operators import ranking

TYPES = [name for name, _ in T.TYPE_MARKERS]
OPEN_TYPES = ["fill", "short"]


def filter_types(rows: DataFrame, allowed: list[str], query: str = "query", check_empty: bool = True) -> DataFrame:
    """Rows of the wanted types, in no other order; no types means all. Types
    that do not exist are an error, and so is a result without rows."""
    wanted = sorted({t.strip() for t in allowed if t.strip()})
    if not wanted:
        return rows
    if unknown := sorted(set(wanted) - set(TYPES)):
        raise ValueError(f"unknown question types: {unknown}")
    kept = rows.where(T.question_type(query).isin(wanted))
    if check_empty and kept.isEmpty():
        raise ValueError(f"no rows are left of the types {wanted}")
    return kept


def required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The rows; reading one that lacks a field is an error."""
    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | (F.coalesce(F.col(f), F.lit("")) == "")
    return rows.where(F.when(lacking, F.raise_error(F.lit(f"a row lacks one of {fields}")).cast("boolean")).otherwise(True))


def short_rows(rows: DataFrame, query: str = "query", keywords: str = "reference_keywords") -> DataFrame:
    """Short-answer rows as QA rows, without those that lack query or keywords."""
    words = F.filter(F.transform(keywords, T.strip), lambda w: w != "")
    ok = rows.where((T.strip(F.coalesce(query, F.lit(""))) != "") & (F.size(words) > 0))
    return ok.withColumn("expected_answer", F.concat(F.lit("[short] "), F.array_join(words, " ||| ")))


def prepare_qa(train: DataFrame, shorts: DataFrame | None, fields: list[str] = ["query", "expected_answer"]) -> DataFrame:  # noqa: B006
    out = required(train, fields).select(*fields)
    return out if shorts is None else out.unionByName(short_rows(shorts).select(*fields))


def positional_split(rows: DataFrame, order: str, val_size: int) -> DataFrame:
    """Adds split: the first rows, a tenth at most, are validation. Rows with
    an empty side leave after the split. The bound is the order value of the last
    validation row, which a distributed top-k finds; rows that share it with
    others beyond the bound are told apart by nothing, so order has to be unique."""
    n = rows.count()
    bound = min(val_size, n // 10)
    last = rows.select(order).orderBy(order).limit(bound).agg(F.max(order)).first()[0] if bound else None
    side = F.when(F.col(order) <= F.lit(last), "val").otherwise("train") if last is not None else F.lit("train")
    return rows.withColumn("split", side).where("coalesce(input, '') <> '' AND coalesce(output, '') <> ''")


def question_key(query: Column | str) -> Column:
    return T.compact(T.question_text(query))


def answer_key(expected: Column | str) -> Column:
    return F.concat(T.expected_type(expected), F.lit(":"), T.compact(T.answer_payload(expected)))


def shown_payload(expected: Column | str) -> Column:
    """The payload as a target shows it: of each item the first form that grading
    reads, or else the first. Grading splits the answers to blanks at semicolons
    and line ends, so those inside a form are spaces here."""
    kind = T.expected_type(expected)
    plain = lambda form: T.strip(F.when(kind == "fill", F.regexp_replace(form, "[;；\n]+", " ")).otherwise(form))
    first = lambda forms: F.coalesce(F.get(F.filter(forms, lambda form: T.loose(form) != ""), 0), F.get(forms, 0))
    shown = F.transform(F.split(T.expected_body(expected), r"\|\|\|"), lambda item: plain(first(F.split(item, "[/／]"))))
    return F.when(kind.isin(OPEN_TYPES), F.array_join(F.filter(shown, lambda x: x != ""), "; ")).otherwise(T.answer_payload(expected))


def direct_splits(rows: DataFrame, order: str = "ord", denominator: int = 20) -> DataFrame:
    """(group_key, kind, messages, n_rows, status, split) by question: groups
    whose answers conflict, or whose first row does not grade itself in full,
    get a status and no split."""
    kind, payload = T.expected_type("expected_answer"), shown_payload("expected_answer")
    completion = F.concat(F.lit("<answer>\\boxed{"), payload, F.lit("}</answer>"))
    keyed = rows.withColumn("group_key", question_key("query")).where("group_key <> ''").withColumn("answer_key", answer_key("expected_answer"))
    groups = keyed.groupBy("group_key").agg(F.count("*").alias("n_rows"), F.count_distinct("answer_key").alias("n_answers"), F.min_by(F.struct("query", "expected_answer"), order).alias("first"))
    flat = groups.select("group_key", "n_rows", "n_answers", "first.*").withColumns({"kind": kind, "completion": completion})
    good = (T.strip("query") != "") & (payload != "") & F.col("kind").isin(TYPES) & (T.question_type("query") == F.col("kind"))
    own = grading.grade("expected_answer", "completion", T.boxed("completion"))
    status = F.when(F.col("n_answers") > 1, "conflict").when(~good, "invalid").when(own != 1.0, "invalid").otherwise("ok")
    side = F.when(ranking.stable_bucket(F.col("group_key"), denominator) == 0, "validation").otherwise("train")
    return flat.withColumn("status", status).select("group_key", "kind", "query", "completion", "n_rows", "status", F.when(F.col("status") == "ok", side).alias("split"))


def split_statistics(splits: DataFrame) -> DataFrame:
    """One row of counts over :func:`direct_splits`. Without any question, sums
    are null, but none is invalid."""
    of = lambda c: F.sum(c.cast("long"))
    s = F.col("status")
    return splits.agg(
        F.count("*").alias("questions"), of(F.col("n_rows") - 1).alias("duplicates"), of(s == "conflict").alias("conflicts"), F.count_if(s == "invalid").alias("invalid"),
        of(s == "ok").alias("kept"), of(F.coalesce(F.col("split") == "validation", F.lit(False))).alias("validation"),
    )


def trajectories(rows: DataFrame, covered: str, reward: str, order: list, scan: dict[str, int], targets: dict[str, int], least: float) -> DataFrame:
    """Cold-start rows (kind, query, ...): each question once, of each type the
    first that are answered in full and, for open types, have evidence enough,
    up to the targets, among the first ones scanned."""
    once = ranking.keep_first(rows.withColumn("group_key", question_key("query")).where("group_key <> ''"), ["group_key"], order)
    pick = lambda d: F.coalesce(F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")], F.lit(0))
    scanned = ranking.top_per_group(once, ["kind"], order, max(scan.values(), default=0), "scan_rank").where(F.col("scan_rank") <= pick(scan))
    enough = ~F.col("kind").isin(OPEN_TYPES) | (F.col(covered) >= least)
    taken = scanned.where(enough & (F.col(reward) == 1.0))
    return ranking.top_per_group(taken, ["kind"], ["scan_rank"], max(targets.values(), default=0), "pick_rank").where(F.col("pick_rank") <= pick(targets))


# Sheets of a question bank, and marks of its example rows.
SHEETS = ["单选题", "多选题", "判断题", "填空题", "简答题"]
EXAMPLES = ["示例导入前请删除", "（示例", "(示例", "这是单选题题目", "这是一道多选题", "这是一道判断题", "这是一道填空题", "这是一道简答题"]


def is_bank(sheets: Column) -> Column:
    return F.arrays_overlap(sheets, F.array(*map(F.lit, SHEETS)))


def header(cell: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(cell, F.lit(""))), r"（必填）|\(必填\)|\*| ", "")


def header_rows(grid: DataFrame) -> DataFrame:
    """(file, sheet, header_row, headers): the first row that names number and
    question; grid has file, sheet, row_num and cells."""
    named = grid.withColumn("headers", F.transform("cells", header))
    front = F.slice("headers", 1, 8)
    found = named.where(F.array_contains(front, "序号") & (F.array_contains(front, "题目") | F.array_contains(front, "试题")))
    return found.groupBy("file", "sheet").agg(F.min("row_num").alias("header_row"), F.min_by("headers", "row_num").alias("headers"))


def column_index(headers: Column, candidates: list[str]) -> Column:
    """The place, from 0, of the first header that contains a candidate or is
    contained in it; candidates in order; null without any."""
    out = F.lit(None).cast("int")
    for name in reversed(candidates):
        hit = F.transform(headers, lambda h: (h != "") & (F.contains(h, F.lit(name)) | F.contains(F.lit(name), h)))  # noqa: B023
        at = F.array_position(hit, True).cast("int")
        out = F.when(at > 0, at - 1).otherwise(out)
    return out


def is_example(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, EXAMPLES)), lambda p: F.contains(question, p))


def padded(cells: Column, start: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: T.clean_cell(F.get(cells, start + k)))


def valid_letters(options: Column) -> Column:
    return F.filter(F.transform(options, lambda o, k: F.when(o != "", F.char(F.lit(65) + k))), lambda x: x.isNotNull())


def bank_questions(rows: DataFrame) -> DataFrame:
    """Adds question, answer, options and issue (null if sound) to rows of a
    sheet: qtype, raw_question, raw_answer, raw_options. Blanks and keywords,
    which are options, are the answers of their types."""
    q = F.col("qtype")
    single, multiple = T.choice_answer("raw_answer", True), T.choice_answer("raw_answer")
    listed = F.nullif(F.array_join(F.filter("options", lambda o: o != ""), "|"), F.lit(""))
    out = rows.withColumns({"question": T.clean_cell("raw_question"), "options": F.transform("raw_options", T.clean_cell)})
    out = out.withColumn("answer", F.when(q == "单选题", single).when(q == "多选题", multiple).when(q == "判断题", T.judge_answer("raw_answer")).otherwise(listed))
    out = out.where((F.col("question") != "") & ~is_example(F.col("question")))
    valid = valid_letters(F.col("options"))
    strange = F.size(F.array_except(F.filter(F.split("answer", ""), lambda x: x != ""), valid)) > 0
    mixed = (q == "判断题") & F.col("question").rlike(r"[A-L][\.、．)]")
    missing = F.when(q == "简答题", "missing_keywords").otherwise("missing_answer")
    issue = F.when(mixed, "looks_like_mixed_choice").when(F.col("answer").isNull(), missing).when(q.isin("单选题", "多选题") & (F.size(valid) > 0) & strange, "answer_out_of_range")
    return out.withColumn("issue", issue)


def once(sound: DataFrame, order: str) -> DataFrame:
    """Each question once, by type, text, options and answer."""
    keyed = sound.withColumn("_options", F.array_join("options", "|"))
    return ranking.keep_first(keyed, ["qtype", "question", "_options", "answer"], [order]).drop("_options")


def numbered(questions: DataFrame, order: str) -> DataFrame:
    """Adds number, from 1 in each type."""
    return questions.withColumn("number", F.row_number().over(Window.partitionBy("qtype").orderBy(order)))


def standardize_bank(rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(questions, issues): sound questions, each once, numbered per type; and
    the reasons of the others."""
    marked = bank_questions(rows)
    issues = marked.where("issue IS NOT NULL").select("qtype", order, "issue", F.concat_ws(":", "qtype", F.concat(F.lit("row"), F.col(order)), "issue").alias("line"))
    return numbered(once(marked.where("issue IS NULL"), order), order), issues


def reject_reasons(issues: DataFrame, strict: bool = False) -> DataFrame:
    """(reason, n), most frequent first. ``strict`` keeps the row number in
    the reason, as lines have it after their first colon."""
    reason = F.regexp_extract("line", r"^[^:]*:(.*)$", 1) if strict else F.col("issue")
    return issues.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
