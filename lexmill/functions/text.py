"""Text columns: normal forms, terms, coverage, answer notation, clean-up.

All are built from Spark SQL functions, so that they stay in the JVM. The
Unicode compatibility form comes from the library that Spark's collations use;
texts of ASCII alone skip it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, cues, word lists and patterns of the data's notation.
ASCII_TOKEN = r"[a-z0-9][a-z0-9_.+-]*"
CJK_RUN = "[\u3400-\u4dbf\u4e00-\u9fff]+"
BLANK_MARKER = r"【\s*\d+\s*】|\[\s*\d+\s*\]|_{2,}|＿{2,}|\(\s*\)|（\s*）"
EXAM_CUE = r"(?im)填空题|选择题|判断题|简答题|每题\s*\d*\s*分|^\s*\d+[.、)]"
ANSWER_CUE = (
    r"(?i)是|为|通过|包括|包含|共有|分别|等于|采用|使用|由.{0,24}组成|"
    r"consists?\s+of|includes?|contains?|there\s+(?:is|are)|\b(?:has|have)\b"
)
SENTENCE_END = r"[\n\r。！？!?；;]+"
STOPWORDS = ["a", "an", "and", "are", "each", "for", "how", "is", "many", "of", "or", "the", "there", "to", "what", "which"]
TYPE_MARKERS = [("single", "一道单选题"), ("multiple", "一道多选题"), ("bool", "一道判断题"), ("fill", "一道填空题"), ("short", "一道简答题")]
SOURCE_ROLE = r"(?i)(?:参考|标准)?答案|答题卡|试卷|试题|题库|已审核|水印|\b(?:answer|solution|exam|quiz)\b|(?:^|[_-])ex$"
ANSWER_ROLE = r"(?i)参考答案|标准答案|答案|讲义|教材|manual|solution|answer|training"
LOOSE = r"[，,。．\.、；;：:！!？\?\"'`（）()【】\[\]/／\\\s]+"
EXPECTED = r"(?s)^\s*\[(\w+)\]\s*(.*)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def strip_bound(c: Column) -> Column:
    """The same of a bound variable, which costs nothing to read: only texts
    that have white space at an end are searched for it."""
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(r"(?U)\s"), strip(c)).otherwise(c)


def strip_bound_ascii(c: Column) -> Column:
    """The same of what ``\\s`` stands for in the SQL: no vertical tab, and
    nothing beyond ASCII."""
    space = r"[\t\n\f\r ]"
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(space), F.regexp_replace(c, rf"^{space}+|{space}+\z", "")).otherwise(c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once per row, also where
    ``use`` needs it in several places or for each element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def nfkc(c: Column | str) -> Column:
    """The Unicode compatibility form, composed."""
    text = col(c)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7f]"), composed).otherwise(text)


def normalize(c: Column | str) -> Column:
    return F.lower(nfkc(c))


def compact(c: Column | str) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(normalize(c), r"[^\p{L}\p{N}]", "")


def _ascii(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(ASCII_TOKEN), F.lit(0))


def ascii_tokens(c: Column | str) -> Column:
    return _ascii(normalize(c))


def terms(c: Column | str, expand_ascii: bool = False) -> Column:
    """Words of ASCII, then two-character runs of CJK text (and the whole run
    up to 12 characters). With ``expand_ascii``, the parts of compound words too."""
    part = lambda t: F.filter(F.split(t, "[^a-z0-9]+"), lambda p: (F.length(p) >= 2) | p.rlike("[0-9]"))
    empty = F.array().cast("array<string>")
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    of_run = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(pairs(r), F.when(F.length(r) <= 12, F.array(r)).otherwise(empty)))

    def of_normal(normal: Column) -> Column:
        tokens = _ascii(normal)
        if expand_ascii:
            tokens = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), part(t))))
        runs = F.regexp_extract_all(normal, F.lit(CJK_RUN), F.lit(0))
        return F.when(F.size(runs) == 0, tokens).otherwise(F.concat(tokens, F.flatten(F.transform(runs, of_run))))

    return let(normalize(c), of_normal)


def without_blanks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), BLANK_MARKER, "")


def informative(c: Column | str) -> Column:
    return F.array_except(F.array_distinct(terms(c)), F.array(*map(F.lit, STOPWORDS)))


def share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(F.lit(0.0))


def coverage(question: Column | str, text: Column | str) -> Column:
    """Share of the question's informative terms that the text has."""
    return let(informative(without_blanks(question)), lambda asked: share(F.array_intersect(asked, terms(text)), asked))


def jaccard(left: Column | str, right: Column | str) -> Column:
    both = F.struct(F.array_distinct(terms(left)).alias("a"), F.array_distinct(terms(right)).alias("b"))
    return let(both, lambda x: share(F.array_intersect(x["a"], x["b"]), F.array_union(x["a"], x["b"])))


def answer_cue(c: Column | str) -> Column:
    return col(c).rlike(ANSWER_CUE)


def sentence_score(question: Column | str, text: Column | str) -> Column:
    """The best sentence's coverage, with a bonus for an answer's wording."""
    cued = lambda s: F.when(answer_cue(s), 0.2).otherwise(0.0)
    score = lambda asked: lambda s: F.least(F.lit(1.0), F.size(F.array_intersect(asked, terms(s))) / F.size(asked) + cued(s))
    best = lambda asked: F.when(F.size(asked) > 0, F.array_max(F.transform(F.split(col(text), SENTENCE_END), score(asked)))).otherwise(F.lit(0.0))
    return let(informative(without_blanks(question)), best)


def copy_score(question: Column | str, text: Column | str, bridge: Column) -> Column:
    """How far a text repeats the question instead of answering it."""
    asked = compact(without_blanks(question))
    exam, covered = col(text).rlike(EXAM_CUE), coverage(question, text)
    return (
        F.when(F.length(asked) < 6, 0.0)
        .when((bridge < 0) | (exam & F.contains(compact(text), asked)), 1.0)
        .when(exam & (covered >= 0.65), covered)
        .otherwise(0.0)
    )


def snippet_relevance(question: Column | str, text: Column | str, bridge: Column) -> Column:
    zero = F.lit(0.0)
    return (
        0.45 * coverage(question, text)
        + 0.30 * sentence_score(question, text)
        + 0.75 * F.greatest(zero, bridge)
        + 0.15 * answer_cue(text).cast("double")
        - 0.80 * copy_score(question, text, bridge)
        - 0.20 * F.greatest(zero, -bridge)
    )


def window_starts(length: Column, limit: int, overlap: int = 80) -> Column:
    step = max(1, limit - min(overlap, limit // 4))
    last = F.when(length <= limit, 0).otherwise(F.ceil((length - limit) / step))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: k * step)


def slices(c: Column | str, step: int, limit: int) -> Column:
    """The ``limit`` characters from each ``step``-th on, joined from pieces
    that are cut in one pass: a substring would be counted from the text's start."""
    pieces = F.regexp_extract_all(col(c), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    joined = lambda all_: lambda p, k: F.left(F.concat(p, *(F.coalesce(F.get(all_, k + n), F.lit("")) for n in range(1, -(-limit // step)))), F.lit(limit))
    return let(pieces, lambda all_: F.transform(all_, joined(all_)))


def windows(c: Column | str, limit: int, overlap: int = 80, blank: bool = False, trim: Callable[[Column], Column] = strip_bound) -> Column:
    """Overlapping pieces of a long text; short texts stay as they are. With
    ``blank``, pieces of white space alone keep their places, as empty ones."""
    text = col(c)
    step = max(1, limit - min(overlap, limit // 4))
    cut = F.slice(slices(text, step, limit), F.lit(1), F.size(window_starts(F.length(text), limit, overlap)))
    pieces = F.transform(cut, trim)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces if blank else F.filter(pieces, lambda p: p != ""))


def snippet_windows(c: Column | str, limit: int) -> Column:
    """A short text whole; else its sentences up to the limit, then windows
    that overlap by half. The stripped text is computed once."""
    empty = F.array().cast("array<string>")

    def of_text(text: Column) -> Column:
        spans = F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;])|\n+"), strip_bound), lambda s: (s != "") & (F.length(s) <= limit))
        fixed = F.filter(F.transform(slices(text, max(1, limit // 2), limit), strip_bound), lambda s: s != "")
        return F.when(text == "", empty).when(F.length(text) <= limit, F.array(text)).otherwise(F.concat(spans, fixed))

    return let(strip(c), of_text)


def question_text(c: Column | str) -> Column:
    text = col(c)
    found = r"(?s)题目[:：]\s*(.*?)(?:\n\s*\n选项[:：]|\z)"
    return F.when(text.rlike(found), strip(F.regexp_extract(text, found, 1))).otherwise(strip(text))


def question_type(c: Column | str) -> Column:
    out = F.lit("unknown")
    for name, marker in reversed(TYPE_MARKERS):
        out = F.when(F.contains(col(c), F.lit(marker)), name).otherwise(out)
    return out


def expected_type(c: Column | str) -> Column:
    return F.regexp_extract(col(c), EXPECTED, 1)


def expected_body(c: Column | str) -> Column:
    return F.regexp_extract(col(c), EXPECTED, 2)


def gold_items(c: Column | str) -> Column:
    """The accepted forms of each answer item, compact; items without any are left out."""
    forms = lambda item: F.filter(F.transform(F.split(item, "[/／]"), compact), lambda x: x != "")
    return F.filter(F.transform(F.split(expected_body(c), r"\|\|\|"), forms), lambda x: F.size(x) > 0)


def answer_payload(c: Column | str) -> Column:
    """The answer to show: closed types as they are, open ones with the first
    form of each item."""
    body = strip(expected_body(c))
    firsts = F.filter(F.transform(F.split(body, r"\|\|\|"), lambda item: strip(F.get(F.split(item, "[/／]"), 0))), lambda x: x != "")
    return F.when(expected_type(c).isin("fill", "short"), F.array_join(firsts, "; ")).otherwise(body)


def memory_payload(c: Column | str) -> Column:
    return strip(F.regexp_replace(expected_body(c), r"\s*\|\|\|\s*", "; "))


def supervised_answer(c: Column | str, most: int = 180) -> Column:
    """An open answer as words to search with: the first form of each item, 48
    characters of each; '' for closed types."""
    firsts = F.transform(gold_items(c), lambda forms: F.left(F.get(forms, 0), F.lit(48)))
    return F.when(expected_type(c).isin("fill", "short"), F.left(F.array_join(firsts, " "), F.lit(max(24, most)))).otherwise("")


def options(c: Column | str) -> Column:
    """The lettered options behind the options mark, as (letter, text), in the
    order of letters' first places; of repeated letters the last text."""
    behind = strip(F.regexp_replace(F.regexp_extract(col(c), r"(?s)选项[:：]\s*(.*)", 1), r"(?U)\s+", " "))
    pieces = F.split(behind, r"\s+(?=[A-Z][.)、:：])")
    item = r"(?s)^\s*([A-Z])\s*[.)、:：]\s*(.*)$"
    found = F.transform(F.filter(pieces, lambda p: p.rlike(item)), lambda p: F.struct(F.regexp_extract(p, item, 1).alias("letter"), strip(F.regexp_extract(p, item, 2)).alias("text")))
    letters_ = F.array_distinct(F.transform(found, lambda o: o["letter"]))
    last = lambda x: F.element_at(F.filter(found, lambda o: o["letter"] == x), -1)
    return F.transform(letters_, last)


def deterministic_query(c: Column | str) -> Column:
    """A search query that the prompt alone decides: the second view of its
    question, or the question; 160 characters."""
    question = question_text(c)
    later = F.filter(F.slice(query_variants(question), 2, 8), lambda v: F.length(compact(v)) >= 3)
    return F.left(strip(F.coalesce(F.get(later, 0), question)), F.lit(160))


def judge_score(c: Column | str) -> Column:
    """The score that a judge's reply tells, from 0 to 1: behind "score", or
    the first number; null without one."""
    named, bare = F.regexp_extract(col(c), r'"score"\s*:\s*([01](?:\.\d+)?)', 1), F.regexp_extract(col(c), r"([01](?:\.\d+)?)", 1)
    found = F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit("")))
    return F.when(found.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), found.cast("double"))))


def loose(c: Column | str) -> Column:
    """Without punctuation and white space, in lower case."""
    return F.regexp_replace(F.lower(strip(c)), LOOSE, "")


def loose_text(s: str) -> str:
    """The same of a string at hand."""
    return re.sub(LOOSE, "", s.strip().lower())


def letters(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(col(c)), F.lit("[A-Z]"), F.lit(0))))


BOX = r"\\boxed\s*\{"


def boxed(c: Column | str) -> Column:
    """The content of the last ``\\boxed{...}`` whose braces balance, inner
    braces and boxes included; null if there is none. Texts whose boxes hold no
    inner brace are read by one pattern; others are followed brace by brace."""
    text = col(c)
    flat = F.try_element_at(F.regexp_extract_all(text, F.lit(BOX + r"([^{}]*)\}"), F.lit(1)), F.lit(-1))
    parts = F.split(text, f"(?={BOX})")

    def closed(rest: Column) -> Column:
        """Up to the brace that closes what opened before."""
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"))
        move = lambda s, ch: F.when(s["depth"] == 0, s).otherwise(
            F.struct((s["depth"] + (ch == "{").cast("int") - (ch == "}").cast("int")).alias("depth"), (s["at"] + 1).alias("at"))
        )
        end = F.aggregate(F.split(rest, ""), start, move, lambda s: F.when(s["depth"] == 0, s["at"]))
        return let(end, lambda at: F.substr(rest, F.lit(1), at - 1))

    after = lambda p, i: F.when(p.rlike(f"^{BOX}"), closed(F.regexp_replace(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""), f"^{BOX}", "")))
    nested = F.try_element_at(F.filter(F.transform(parts, after), lambda x: x.isNotNull()), F.lit(-1))
    return F.when(text.rlike(BOX + r"[^{}]*\{"), nested).otherwise(flat)


def source_title(c: Column | str) -> Column:
    bare = F.when(col(c).startswith("20260611160325_"), F.substr(col(c), F.lit(16))).otherwise(col(c))
    return F.regexp_replace(bare, r"\.xlsx?$", "")


def family_key(c: Column | str) -> Column:
    """The same for files that differ in their role words alone; '' if nothing else is left."""
    path = col(c)
    stem = compact(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), SOURCE_ROLE, ""))
    parent = compact(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    return F.when(stem != "", F.concat(parent, F.lit("/"), stem)).otherwise("")


def has_answer_role(c: Column | str) -> Column:
    return col(c).rlike(ANSWER_ROLE)


def number_answer(c: Column | str) -> Column:
    """What follows ``####``, without thousands' commas; else the stripped text."""
    found = F.regexp_extract(col(c), r"####\s*(-?[\d,.]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(strip(c))


def prompt(instruction: Column | str, context: Column | str) -> Column:
    return F.when(F.coalesce(col(context), F.lit("")) != "", F.concat(col(instruction), F.lit("\n\n"), col(context))).otherwise(col(instruction))


def clean_cell(c: Column | str) -> Column:
    """Without zero-width characters, white space as single spaces."""
    text = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "[\u200b-\u200d\ufeff]", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def choice_answer(c: Column | str, single: bool = False) -> Column:
    """The letters A to L in order, each once; null if there is none."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(clean_cell(c)), F.lit("[A-L]"), F.lit(0)))
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 1) if single else found, ""))


def judge_answer(c: Column | str) -> Column:
    said = F.lower(clean_cell(c))
    right, wrong = ["对", "正确", "true", "t", "yes", "y", "√", "是", "a"], ["错", "错误", "false", "f", "no", "n", "×", "否", "不对", "b"]
    return F.when(said.isin(right), "对").when(said.isin(wrong), "错")


def knowledge_points(c: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[|｜]"), clean_cell), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, 5), "|")


def safe_label(c: Column | str) -> Column:
    return F.translate(col(c), "<>", "＜＞")


def search_tag(c: Column | str) -> Column:
    """What the first search element asks for; null without one."""
    found = r"(?is)<search>\s*(.*?)\s*</search>"
    return F.when(col(c).rlike(found), F.regexp_extract(col(c), found, 1))


def rank_ids(c: Column | str, n_candidates: Column | int, limit: int) -> Column:
    """Positions, from 0, named by their numbers from 1, each once."""
    n = F.lit(n_candidates) if isinstance(n_candidates, int) else n_candidates
    numbers = F.transform(F.regexp_extract_all(col(c), F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int") - 1)
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: (x >= 0) & (x < n))), 1, limit)


def query_list(c: Column | str, limit: int) -> Column:
    """Search queries from a model's answer: a JSON list if there is one, else lines."""
    text = strip(c)
    listed = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), F.lit("")), "array<string>")
    full = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: strip(s) != "")
    lines = F.transform(full, lambda s: F.regexp_replace(s, r"^\s*(?:[-*]|\d+[.、)])\s*", ""))
    raw = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(lines)
    bare = lambda s: strip(F.regexp_replace(s, "(?i)</?search>", ""))
    tidy = F.transform(raw, lambda s: F.left(F.regexp_replace(bare(s), "^[`\"'\\[\\] ]+|[`\"'\\[\\] ]+$", ""), F.lit(160)))
    key = lambda s: F.lower(F.regexp_replace(s, r"(?U)\s+", ""))
    kept = F.filter(tidy, lambda s: F.length(key(s)) >= 2)
    keys = F.transform(kept, key)
    return F.slice(F.filter(kept, lambda s, i: F.array_position(keys, key(s)) == i + 1), 1, max(1, limit))


def query_variants(question: Column | str, search: Column | str | None = None, limit: int = 8) -> Column:
    """Views of a question to search with: the model's query with the
    question, the question, its ASCII words, the parts between blanks and its
    CJK runs; each once by compact form."""
    q = strip(question)
    none = F.array().cast("array<string>")
    asked = strip(F.lit("") if search is None else search)
    pieces = F.flatten(F.transform(ascii_tokens(q), lambda t: F.when(F.size(F.filter(F.split(t, "[^a-z0-9]+"), lambda p: p != "")) > 0, F.filter(F.split(t, "[^a-z0-9]+"), lambda p: p != "")).otherwise(F.array(t))))
    words = F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= 2))
    parts = F.filter(F.transform(F.split(q, BLANK_MARKER), strip), lambda p: F.length(compact(p)) >= 4)
    run_parts = lambda r: F.when(F.length(r) <= 12, F.array(r)).otherwise(F.transform(F.sequence(F.lit(0), F.length(r) - 1, F.lit(6)), lambda at: F.substr(r, at + 1, F.lit(8))))
    runs = F.flatten(F.transform(F.regexp_extract_all(q, F.lit(CJK_RUN), F.lit(0)), run_parts))
    every = F.concat(
        F.when(asked != "", F.array(F.concat(asked, F.lit("\n"), q))).otherwise(none), F.array(q), F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(none), parts, runs
    )
    kept = F.filter(every, lambda v: F.length(compact(v)) >= 3)
    keys = F.transform(kept, compact)
    return F.slice(F.filter(kept, lambda v, i: F.array_position(keys, compact(v)) == i + 1), 1, limit)


# The shapes of log prefixes and stamps.
COLOUR, BARE_COLOUR = "\u001b\\[[0-9;]*[mM]", r"\[\d{1,3}m"
WORKER = r"^([^(]*)\([A-Za-z][\w.]*\s+pid=\d+,\s*ip=[\d.]+\)\s*"
STAMPED = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+"
LEVELLED = r"(?s)^(INFO|WARNING|ERROR|DEBUG)\s+(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(.*)$"


def log_line(c: Column | str, now: str) -> Column:
    """A log line without colours and worker prefixes, with a time stamp in
    front: its own, the one of its level with the year of ``now``, or ``now``."""
    plain = F.regexp_replace(F.regexp_replace(col(c), COLOUR, ""), BARE_COLOUR, "")
    for _ in range(2):
        plain = F.regexp_replace(F.regexp_replace(plain, WORKER, "$1"), r"(?U)^\s+", "")
    part = lambda k: F.regexp_extract(plain, LEVELLED, k)
    levelled = F.concat(F.lit(f"{now[:4]}-"), part(2), F.lit(" "), part(3), F.lit(" "), strip(F.concat(part(1), F.lit(" "), part(4))))
    return F.when(plain == "", col(c)).when(plain.rlike(STAMPED), plain).when(plain.rlike(LEVELLED), levelled).otherwise(F.concat(F.lit(f"{now} "), plain))


def human_bytes(c: Column | str) -> Column:
    n = col(c).cast("double")
    out = F.format_string("%.1f GB", n / 1024**3)
    for power, unit in ((2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%.0f B", n)).otherwise(out)


def elapsed(c: Column | str) -> Column:
    s = F.greatest(col(c).cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def experiment_parts(c: Column | str) -> Column:
    parts = F.split(col(c), "_")
    return F.struct(*(F.get(parts, k).alias(n) for k, n in enumerate(("method", "model", "dataset"))), F.when(F.size(parts) > 3, F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "_")).alias("tag"))
