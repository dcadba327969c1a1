"""Sinks for score sheets, assessment snapshots and the call log, and cache re-reads.

Snapshots are parquet partitioned by ``as_of`` (and the score sheet CSV by
workspace), so re-scoring or re-reporting a past run reads only its partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = "workspace_id"
SQL_OUTPUT_CUT = 2000
SQL_CALL = "/api/2.0/sql/statements"


def write_score_sheet(sheet: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV per workspace with a header, rows in sheet order."""
    (sheet.repartition(WS).sortWithinPartitions(WS, "row_seq")
     .write.mode(mode).partitionBy(WS).option("header", True).csv(path))


def write_snapshot(tables: dict[str, DataFrame], root: str, as_of: dt.date, mode: str = "overwrite") -> None:
    """Persist ``inputs``, ``scores``, ``assessment``... under ``root/<name>/as_of=<date>``.

    ``partitionOverwriteMode=dynamic`` keeps other dates when one run is rewritten.
    """
    for name, df in tables.items():
        out = df if "as_of" in df.columns else df.withColumn("as_of", F.lit(as_of))
        (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("as_of").parquet(f"{root.rstrip('/')}/{name}"))


def read_snapshot(spark: SparkSession, root: str, name: str, as_of: dt.date | None = None) -> DataFrame:
    """Read a snapshot table back; the ``as_of`` filter prunes partitions."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return df if as_of is None else df.where(F.col("as_of") == F.lit(as_of)).drop("as_of")


def append_calls(calls: DataFrame, path: str, sql_calls: bool = False) -> None:
    """Plain append of call-log rows (a repeated append repeats them; see ``commit_calls``);
    SQL call output is cut to 2000 characters."""
    out = calls
    if sql_calls:
        out = out.withColumn("output", F.substring("output", 1, SQL_OUTPUT_CUT))
    out.write.mode("append").parquet(path)


def commit_calls(calls: DataFrame, root: str, run: str, attempt: str | None = None) -> int:
    """Append one run's calls so that each (run, collector) counts once; rows committed.

    The rows go to a folder of this attempt, which no reader looks at by itself. After the
    write, one manifest row per collector names the attempt; only then do its rows exist for
    readers. A retried run, or two runs racing, may write rows and manifest entries again:
    the earliest entry of (run, collector) holds, the others are never read. Collectors of the
    run that are committed already are not written again, so a run that failed between
    collectors goes on where it stopped.
    """
    import uuid

    spark, attempt = calls.sparkSession, attempt or uuid.uuid4().hex
    done = manifest(spark, root).where(F.col("run") == run).select("collector")
    todo = calls.join(done, calls["collector"].eqNullSafe(done["collector"]), "left_anti")
    data = f"{root.rstrip('/')}/data/run={run}/attempt={attempt}"
    cut_sql_output(todo.withColumn("command", F.concat_ws(" ", F.col("command"))) if dict(todo.dtypes)["command"].startswith("array")
                   else todo).write.mode("error").parquet(data)
    entries = (spark.read.schema(todo.select("collector").schema).parquet(data).groupBy("collector").agg(F.count(F.lit(1)).alias("calls"))
               .select(F.lit(run).alias("run"), "collector", F.lit(attempt).alias("attempt"), "calls", F.current_timestamp().alias("committed_at")))
    entries.write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return int(manifest(spark, root).where((F.col("run") == run) & (F.col("attempt") == attempt)).agg(F.sum("calls")).first()[0] or 0)


_MANIFEST = "run string, collector string, attempt string, calls long, committed_at timestamp"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The attempt that holds for every committed (run, collector)."""
    path = f"{root.rstrip('/')}/manifest"
    try:
        rows = spark.read.schema(_MANIFEST).parquet(path)
    except AnalysisException:      # nothing committed yet
        rows = spark.createDataFrame([], _MANIFEST)
    first = F.struct("committed_at", "attempt")
    return rows.groupBy("run", "collector").agg(F.min_by(F.struct("attempt", "calls", "committed_at"), first).alias("m")).select(
        "run", "collector", "m.*")


def read_calls(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Committed calls, each once: the data of the attempts that the manifest names."""
    held = manifest(spark, root).select(F.col("run").alias("_run"), F.col("collector").alias("_collector"), F.col("attempt").alias("_attempt"))
    rows = spark.read.schema(f"{schema}, run string, attempt string").parquet(f"{root.rstrip('/')}/data")
    return rows.join(held, (F.col("run") == F.col("_run")) & (F.col("attempt") == F.col("_attempt"))
                     & F.col("collector").eqNullSafe(F.col("_collector")), "left_semi").drop("attempt")


def cut_sql_output(flat: DataFrame) -> DataFrame:
    """Flattened calls with the output of SQL statement calls cut; command output stays whole."""
    is_sql = F.coalesce(F.col("command").contains(SQL_CALL), F.lit(False))
    return flat.withColumn("output", F.when(is_sql, F.substring("output", 1, SQL_OUTPUT_CUT)).otherwise(F.col("output")))


def flatten_calls(calls: DataFrame) -> DataFrame:
    """Command words joined by spaces and the report's column names."""
    return calls.select(
        WS, "seq", "collector",
        F.concat_ws(" ", F.col("command")).alias("command"),
        F.col("output"), F.col("duration_seconds").alias("duration"),
        "success", "error")
