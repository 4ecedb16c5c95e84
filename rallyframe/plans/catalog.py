"""The catalog of matches: state machine, result sink, cascading delete."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import add_rows, remove, shared_dir, stored

#: What each action of a job needs and leads to.
TRANSITIONS = (("start", "uploading", "queued"), ("begin", "queued", "processing"), ("finish", "processing", "completed"), ("fail", "processing", "failed"), ("retry", "failed", "processing"))
STATUSES = ("uploading", "queued", "processing", "completed", "failed")
MAX_UPLOAD_MB = 2048


def transitions(matches: DataFrame, requests: DataFrame) -> DataFrame:
    """id, action, status, new_status, code: 404 unknown match, 409 wrong state, 200 done.

    requests: id, action.
    """
    rules = F.when(F.lit(False), F.lit(None).cast("string"))
    for action, source, target in TRANSITIONS:
        rules = rules.when((F.col("action") == action) & (F.col("status") == source), target)
    out = requests.join(matches.select("id", "status"), "id", "left").withColumn("to", rules)
    code = F.when(F.col("status").isNull(), 404).when(F.col("to").isNull(), 409).otherwise(200)
    return out.select("id", "action", "status", F.coalesce("to", "status").alias("new_status"), code.alias("code"))


def accepts_upload(requests: DataFrame) -> DataFrame:
    """id, size_bytes, code: 413 beyond the limit, 422 for no positive size."""
    code = F.when(F.col("size_bytes") <= 0, 422).when(F.col("size_bytes") > MAX_UPLOAD_MB * 1024 * 1024, 413).otherwise(200)
    return requests.select("id", "size_bytes", code.alias("code"))


def valid_matches(matches: DataFrame) -> DataFrame:
    """Titles of 1 to 200 characters, at most four names, a known status."""
    return matches.where(F.length("title").between(1, 200) & (F.coalesce(F.size("player_names"), F.lit(0)) <= 4) & F.col("status").isin(*STATUSES))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows that stay; the same call on each dependent table makes the cascade."""
    return table.join(ids.select(F.col("id").alias("__id")), F.col(key) == F.col("__id"), "left_anti")


def delete_cascade(ids: DataFrame, matches: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """The rows that stay of the matches and of each dependent table, which names its match in match_id."""
    return {"matches": delete(matches, ids)} | {name: delete(rows, ids, "match_id") for name, rows in dependents.items()}


def error_message(text: Column) -> Column:
    return F.left(text, F.lit(1000))


def _now() -> Column:
    return F.unix_micros(F.current_timestamp())


_BLOOM = {"parquet.bloom.filter.enabled#match_id": "true"}


def save_stats(stats: DataFrame, path: str) -> None:
    """Add results to those stored; the newest of a match counts, so a repeated job leaves the same results.

    Rows are only ever added, each time in a folder of their own, so writers at the same time lose nothing of each other.
    Files are sorted by match and have Bloom filters, so a lookup reads few row groups.
    """
    add_rows(stats.withColumn("saved_at", _now()).sortWithinPartitions("match_id"), path, **_BLOOM)


def load_stats(spark: SparkSession, path: str, schema: str | None = None, match_id: object = None) -> DataFrame:
    """The newest result of each match, or of one. Columns that later versions added are null in earlier files.

    Without a schema the footers of all files are read for theirs.
    """
    reader = spark.read.schema(f"{schema}, saved_at long") if schema else spark.read.option("mergeSchema", "true")
    rows = reader.parquet(path)
    if match_id is not None:
        rows = rows.where(F.col("match_id") == match_id)
    newest = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("saved_at")))
    return rows.withColumn("newest", newest).where("newest = 1").drop("newest", "saved_at", "added")


def compact_stats(spark: SparkSession, path: str) -> None:
    """Write the newest results into files of their own and delete the files they came from.

    Results added meanwhile are in other files and stay; if it ends in between, results are stored twice, which changes nothing.
    """
    all_rows = spark.read.option("mergeSchema", "true").parquet(path)
    files = all_rows.inputFiles()
    newest = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("saved_at")))
    kept = stored(all_rows.withColumn("newest", newest).where("newest = 1").drop("newest", "added"), "stats")
    add_rows(kept.repartitionByRange(F.col("match_id")).sortWithinPartitions("match_id"), path, **_BLOOM)
    for file in files:
        remove(spark, file)


#: States of jobs as they are stored: every change is a row.
STATES = "id string, at long, run string, attempt long, status string, progress int, error_message string"


def record_states(rows: DataFrame, path: str) -> None:
    """Add rows of STATES without `at`."""
    add_rows(rows.select("id", _now().alias("at"), "run", F.col("attempt").cast("long").alias("attempt"), "status", F.col("progress").cast("int").alias("progress"), "error_message"), path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STATES).parquet(path).drop("added")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], STATES)


def _owners(states: DataFrame) -> DataFrame:
    """id, attempt, run: who works on each attempt, the first that claimed it."""
    claims = states.where("status = 'processing' and progress = 0")
    return claims.groupBy("id", "attempt").agg(F.min_by("run", F.struct("at", "run")).alias("run"))


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """id, status, progress, error_message: the last that the owner of the last attempt has told."""
    states = load_states(spark, path)
    told = states.join(_owners(states), ["id", "attempt", "run"], "left_semi")
    over = F.col("status") != "processing"
    last = F.max_by(F.struct("status", "progress", "error_message"), F.struct("attempt", over, "at", "progress")).alias("s")
    return told.groupBy("id").agg(last).select("id", "s.*")


def claim(queued: DataFrame, path: str, run: str) -> DataFrame:
    """id, attempt of the queued matches that this run has won; those that another run claimed first are its.

    A claim is a row that is added and then read back with all others. An attempt that has ended makes room for the next.
    """
    spark = queued.sparkSession
    ended = load_states(spark, path).where("status in ('completed', 'failed')").groupBy("id").agg(F.max("attempt").alias("ended"))
    wanted = queued.select("id").join(ended, "id", "left").select("id", (F.coalesce("ended", F.lit(0)) + 1).alias("attempt"))
    mine = stored(wanted.select("id", F.lit(run).alias("run"), "attempt", F.lit("processing").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error_message")), "claims")
    record_states(mine, path)
    won = _owners(load_states(spark, path)).where(F.col("run") == run)
    return stored(mine.join(won, ["id", "attempt", "run"], "left_semi").select("id", "attempt"), "won")


def run_jobs(matches: DataFrame, analysis: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]], path: str, states: str | None = None) -> DataFrame:
    """Analyse all queued matches in one go, save their results, and return the matches with their new status.

    matches: id (string), status, progress, error_message. analysis: from the processing matches (id, match_id) to their
    result documents, or to these and the errors of single matches (id, message), such as `perceive` finds. A match with
    an error or without a result has failed alone, and its message says why. Progress is 100 or stays. Claims, progress
    and ends are stored at `states`, in which several runs can share the work.
    """
    spark, run = matches.sparkSession, uuid.uuid4().hex
    states = states or f"{shared_dir(spark)}/states"
    won = claim(matches.where("status = 'queued'"), states, run)
    begun = won.select("id", F.col("id").cast("bigint").alias("match_id"))
    found = analysis(begun)
    results, errors = found if isinstance(found, tuple) else (found, None)
    none = spark.createDataFrame([], "id string, message string")
    errors = stored((none if errors is None else errors).groupBy("id").agg(F.min("message").alias("message")), "errors")
    results = results.withColumn("id", F.col("match_id").cast("string")).join(errors, "id", "left_anti")
    results = stored(results.join(won, "id", "left_semi").drop("id"), "results")
    record = lambda rows, status, progress: record_states(rows.select("id", F.lit(run).alias("run"), "attempt", F.lit(status).alias("status"), progress, "error_message"), states)
    nothing = F.lit(None).cast("string").alias("error_message")
    record(won.select("id", "attempt", nothing), "processing", F.lit(90).alias("progress"))
    save_stats(results, path)
    done = results.select(F.col("match_id").cast("string").alias("id")).distinct()
    why = F.coalesce(error_message(F.col("message")), F.concat(F.lit("no tracks for match "), "id")).alias("error_message")
    record(won.join(done, "id", "left_semi").select("id", "attempt", nothing), "completed", F.lit(100).alias("progress"))
    lost = stored(won.join(done, "id", "left_anti").join(errors, "id", "left").select("id", "attempt", why), "lost")
    before = matches.select("id", "progress")
    record(lost.join(before, "id").select("id", "attempt", "error_message", "progress"), "failed", F.col("progress"))
    now = current_states(spark, states).join(won, "id", "left_semi").select("id", F.col("status").alias("s"), F.col("progress").alias("p"), F.col("error_message").alias("e"))
    told = matches.join(stored(now, "states"), "id", "left")
    new = F.col("s").isNotNull()
    return told.select("id", F.coalesce("s", "status").alias("status"), F.coalesce("p", "progress").cast("int").alias("progress"), F.when(new, F.col("e")).otherwise(F.col("error_message")).alias("error_message"))


def stored_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below a folder in any store; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def orphans(objects: DataFrame, matches: DataFrame) -> DataFrame:
    """The objects of no match: videos (<id>.<suffix>) and crops (<id>/<player>.<suffix>, in a folder `crops`) of others than these ids."""
    of = F.coalesce(F.nullif(F.regexp_extract("path", r"/crops/([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return objects.withColumn("of", of).join(matches.select(F.col("id").alias("of")), "of", "left_anti").select("path", "length", "of")


def delete_objects(objects: DataFrame) -> DataFrame:
    """path, deleted: the objects' files are deleted by the tasks that read the rows; one that is gone already counts as deleted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = []
            for path in batch["path"]:
                store, place = fs.FileSystem.from_uri(path)
                if store.get_file_info(place).type == fs.FileType.File:
                    store.delete_file(place)
                gone.append(store.get_file_info(place).type == fs.FileType.NotFound)
            yield pd.DataFrame({"path": batch["path"], "deleted": gone})

    return stored(objects.select("path").mapInPandas(run, "path string, deleted boolean"), "deleted")


def job_log(updates: DataFrame, step: int = 5) -> DataFrame:
    """Progress updates worth storing: each `step` points or more on from the last stored (-1 at first), and any 100.

    updates: match_id, seq, progress. A stored value below 100 is above all before it, so only such records, at most 100
    a match, go through the fold that the rule needs.
    """
    before = F.max("progress").over(Window.partitionBy("match_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    full = updates.where("progress >= 100").select("match_id", F.col("progress").cast("int").alias("progress"))
    records = updates.withColumn("before", before).where("progress < 100 and progress > coalesce(before, -1)")
    rows = records.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("seq", "progress"))).alias("rows"))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("kept"))

    def fold(state, x):
        keep = x["progress"] >= state["last"] + step
        return F.struct(F.when(keep, x["progress"]).otherwise(state["last"]).alias("last"), F.when(keep, F.array_append(state["kept"], x["progress"])).otherwise(state["kept"]).alias("kept"))

    stored_ = rows.select("match_id", F.explode(F.aggregate("rows", start, fold, lambda s: s["kept"])).alias("progress"))
    return stored_.unionByName(full)
