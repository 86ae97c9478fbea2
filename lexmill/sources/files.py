"""Files in and out: JSON lines, Markdown folders, event streams, corpora.

Readers give an explicit order column where order has a meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines without blank ones; ``file`` and ``ord`` (in the
    order of the lines of a file read in one piece) keep the source's order."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("ord", F.monotonically_increasing_id())
    rows = lines.where(T.strip("value") != "").select("file", "ord", F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r"))
    return rows.select("file", "ord", "r.*")


def write_jsonl(df: DataFrame, path: str, partitions: int | None = None) -> None:
    (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_chat_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df.select("messages"), path)


def read_split_table(spark: SparkSession, path: str, fmt: str = "parquet", names: dict[str, str] | None = None) -> DataFrame:
    """A dataset kept in folders per split, its ``test`` split as ``val``."""
    names = {"test": "val", "validation": "val"} if names is None else names
    split = F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]+)(?:-[^/]*)?(?:/[^/]*)?\.[a-z]+$", 1)
    out = spark.read.format(fmt).load(path).withColumn("split", split)
    for old, new in names.items():
        out = out.withColumn("split", F.when(F.col("split") == old, new).otherwise(F.col("split")))
    return out


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of the Markdown files below a folder; source is the path
    in it. A folder that is not there is an error; unreadable files are left out."""
    base = unquote(urlparse(folder).path or folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", "true").load(folder)
    path = F.expr("reflect('java.net.URLDecoder', 'decode', replace(path, '+', '%2B'), 'UTF-8')")
    source = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/+", "/"), f"^{_quoted(base)}", "")
    return files.select(source.alias("source"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def path_order(source: Column | str = "source") -> Column:
    """Sorts as paths do, part by part."""
    return F.split(T.col(source), "/")


HEADING = r"^#{1,6}\s+(.+?)\s*$"


def markdown_blocks(files: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, block, body): paragraphs under the heading that holds for
    them, or the file's name; bodies start with it in brackets."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", "")
    lines = files.select(source, stem.alias("stem"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", T.strip("raw"))
    titled = F.regexp_extract("line", HEADING, 1)
    upto = Window.partitionBy(source).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("title", F.when(F.col("line").rlike(HEADING), titled))
    breaks = F.sum(((F.col("line") == "") | F.col("title").isNotNull()).cast("int")).over(upto)
    marked = marked.withColumns({"heading": F.coalesce(F.last("title", ignorenulls=True).over(upto), "stem"), "part": breaks})
    body = marked.where("line <> '' AND title IS NULL").groupBy(source, "part", "heading").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    joined = F.concat(F.lit("["), F.col("heading"), F.lit("]\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return body.select(source, F.col("part").alias("block"), joined.alias("body"))


def pack_blocks(blocks: DataFrame, limit: int = 480, source: str = "source") -> DataFrame:
    """(source, pos, text): blocks in order, put together while they fit the
    limit; longer ones are cut into overlapping windows. The fold runs over
    one file's blocks at a time."""
    limit = max(160, limit)
    listed = blocks.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]).alias("bodies"))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("open"), empty.alias("done"))
    closed = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, b: Column) -> Column:
        cut = F.struct(F.lit("").alias("open"), F.concat(closed(s), T.windows(b, limit)).alias("done"))
        first = F.struct(b.alias("open"), s["done"].alias("done"))
        more = F.struct(F.concat(s["open"], F.lit("\n\n"), b).alias("open"), s["done"].alias("done"))
        anew = F.struct(b.alias("open"), closed(s).alias("done"))
        fits = F.length(s["open"]) + 2 + F.length(b) <= limit
        return F.when(F.length(b) > limit, cut).when(s["open"] == "", first).when(fits, more).otherwise(anew)

    packed = listed.select(source, F.aggregate("bodies", start, step, closed).alias("chunks"))
    return packed.select(source, F.posexplode("chunks").alias("pos", "text"))


def sse_events(lines: DataFrame, stream: str = "stream", order: str = "line_no", line: str = "line") -> DataFrame:
    """(stream, event_no, event, event_id, data): data lines up to a blank one
    are an event; an id holds until the next; comments count for nothing; what
    is not ended is an event too."""
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    upto = Window.partitionBy(stream).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    name = F.regexp_extract("_l", r"^([^:]*)", 1)
    value = F.regexp_replace(F.when(F.contains("_l", F.lit(":")), F.regexp_extract("_l", r"(?s)^[^:]*:(.*)$", 1)).otherwise(""), "^ ", "")
    rows = lines.withColumn("_l", bare).where(~F.col("_l").startswith(":"))
    rows = rows.withColumn("event_no", F.coalesce(F.sum((F.col("_l") == "").cast("long")).over(before), F.lit(0)))
    rows = rows.withColumns({"_f": name, "_v": value}).withColumn("_id", F.last(F.when(F.col("_f") == "id", F.col("_v")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    data = F.array_sort(F.collect_list(F.when(F.col("_f") == "data", F.struct(order, "_v"))))
    events = rows.groupBy(stream, "event_no").agg(
        F.max_by("_v", F.when(F.col("_f") == "event", F.col(order))).alias("event"), F.max_by("_id", order).alias("event_id"), F.transform(data, lambda x: x["_v"]).alias("parts")
    )
    return events.where(F.size("parts") > 0).select(stream, "event_no", F.coalesce("event", F.lit("message")).alias("event"), "event_id", F.array_join("parts", "\n").alias("data"))


def safe_name(title: Column) -> Column:
    return F.left(T.strip(F.regexp_replace(title, r'[\\/:*?"<>|\s]+', "_")), F.lit(120))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, word) of a JSON file with groups of words that mean the same:
    words in loose form, empty ones left out, groups in order."""
    groups = spark.read.schema("groups array<array<string>>").option("multiLine", "true").json(path)
    words = groups.select(F.posexplode("groups").alias("group_id", "words")).select("group_id", F.explode("words").alias("word"))
    return words.select("group_id", T.loose("word").alias("word")).where("word != ''").distinct()


def synonym_groups(table: DataFrame) -> list[list[str]]:
    """The same as lists, for expressions: a table of synonyms is small."""
    rows = table.groupBy("group_id").agg(F.array_sort(F.collect_set("word")).alias("words")).orderBy("group_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 groups of synonyms do not belong in an expression; join the table instead")
    return [r.words for r in rows]


def grid_rows(cells: DataFrame, loader: Callable | None = None) -> DataFrame:
    """Workbook grids (file, sheet, row_num, cells) without temporary files.
    ``loader`` turns binaryFile rows into grids where a reader is at hand."""
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    return (cells if loader is None else cells.mapInPandas(loader, "file string, sheet string, row_num int, cells array<string>")).where(~name.startswith("~$"))


def relative(path: str, base: str) -> str:
    return str(PurePosixPath(path).relative_to(base))
