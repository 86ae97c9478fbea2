"""The run ledger: listings, checkpoints and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an upload leaves out, and files whose line ends are made uniform.
EXCLUDED_DIRS = r"^(\.cursor|docs|reports)(/|$)"
EXCLUDED_FILES = r"(?i)\.pdf$"
UNIX_FILES = r"(^|/)lab$|\.(sh|conf)$"


def list_runs(ledger: DataFrame, contains: str = "", limit: int = 20, run_id: str | int | None = None) -> DataFrame:
    """The latest runs of experiments whose name contains a text; with
    ``run_id``, that run."""
    ledger = ledger if run_id is None else ledger.where(F.col("run_id") == run_id)
    return ledger.where(F.contains("exp", F.lit(contains))).orderBy(F.desc("submitted_at"), F.desc("run_id")).limit(limit)


def steps(dirs: DataFrame, name: str = "dir") -> DataFrame:
    """Checkpoint folders with their step number; others are left out."""
    return dirs.withColumn("step", F.regexp_extract(name, r"(?:^|/)step_(\d+)/?$", 1)).where("step <> ''").withColumn("step", F.col("step").cast("long"))


def latest_checkpoint(dirs: DataFrame, root: str = "root", name: str = "dir", wanted: int | None = None) -> DataFrame:
    """Per root the folder of the highest step, or of the step wanted."""
    found = steps(dirs, name)
    found = found if wanted is None else found.where(F.col("step") == wanted)
    return found.groupBy(root).agg(F.max_by(name, "step").alias(name), F.max("step").alias("step"))


def backend(files: DataFrame, root: str = "root", name: str = "entry") -> DataFrame:
    """(root, backend, iteration): megatron if there is an iter_ entry, the
    last by name; else dcp."""
    it = F.when(F.col(name).rlike("^iter_"), F.col(name))
    return files.groupBy(root).agg(F.max(it).alias("iteration")).withColumn("backend", F.when(F.col("iteration").isNotNull(), "megatron").otherwise("dcp"))


def latest_run(runs: DataFrame, checkpoints: DataFrame, root: str = "root", name: str = "run_dir", mtime: str = "mtime") -> DataFrame:
    """Per root the newest run that has a checkpoint, the first of equals; a
    root that holds checkpoints itself, as older ones do, is its own run.
    ``checkpoints``: folders, with the run that they are in or null."""
    found = steps(checkpoints)
    flat = found.where(F.col(name).isNull()).select(root).distinct()
    held = runs.join(found.select(root, name).distinct(), [root, name], "left_semi").join(flat, root, "left_anti")
    order = Window.partitionBy(root).orderBy(F.desc(mtime), name)
    best = held.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(root, F.col(name).alias("run"))
    return best.unionByName(flat.select(root, F.col(root).alias("run")))


def alive(actors: DataFrame, job: str = "job_id", jobs: DataFrame | None = None, here: str | None = None) -> DataFrame:
    """(job_id, node_ids, pids) of actors that are neither dead nor
    restarting. With ``jobs`` every job has a row, one without such actors on the
    node ``here``, without processes that are known."""
    up = actors.where(~F.col("state").isin("DEAD", "RESTARTING"))
    found = up.groupBy(job).agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"), F.array_sort(F.collect_set("pid")).alias("pids"))
    if jobs is None:
        return found
    return jobs.select(job).distinct().join(found, job, "left").withColumn("node_ids", F.coalesce("node_ids", F.array(F.lit(here))))


def owns_gpu(job_pids: Column, gpu_pids: Column, memory: Column, least_memory: float) -> Column:
    """Without known processes, memory decides; else a process must be shared."""
    return F.when(job_pids.isNull(), memory >= least_memory).when(F.size(job_pids) == 0, False).otherwise(F.arrays_overlap(job_pids, gpu_pids))


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def uploaded(path: Column) -> Column:
    return ~_slashes(path).rlike(EXCLUDED_DIRS) & ~_slashes(path).rlike(EXCLUDED_FILES)


def needs_unix_lines(path: Column) -> Column:
    return _slashes(path).rlike(UNIX_FILES)


def unix_lines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")
