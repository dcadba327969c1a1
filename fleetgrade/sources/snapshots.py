"""The current pages of a landing table that pages reach more than once.

A collector run lands its pages as rows ``(workspace_id, endpoint, page, body, landing,
pages, landed_at)``: ``landing`` is the run's number, ``pages`` how many pages this endpoint's
answer has in that run, ``landed_at`` orders copies of one page. Runs overlap (a retried
upload lands a page twice), stop half-way and finish late. The table is only ever appended
to; which rows count is decided when it is read:

* of one page landed twice in a run, the newest copy counts;
* a run counts for (workspace, endpoint) once all its pages ``0 .. pages-1`` are there;
* of the complete runs the greatest number counts, wherever its last page landed.

Endpoints of one workspace resolve on their own, so a run that failed on one endpoint still
renews the others. The query string of a call does not make another endpoint.

Scale: the decision reads keys only (column pruning leaves the bodies unread) and is two
partial aggregates; bodies of outdated runs are dropped by a semi join before any shuffle
of bodies, and only pages that really landed twice are aggregated with their body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrade.sources.inventory import PAYLOAD_SCHEMA, WS

LANDING_SCHEMA = T.StructType([*PAYLOAD_SCHEMA.fields, T.StructField("landing", T.LongType()),
                               T.StructField("pages", T.IntegerType()), T.StructField("landed_at", T.LongType())])
BUCKETS = 64
_SET = [WS, "path", "landing"]
_PAGE = [*_SET, "page"]


def _path() -> Column:
    return F.substring_index("endpoint", "?", 1).alias("path")


def page_keys(landings: DataFrame) -> DataFrame:
    """Distinct pages of every run with their number of copies; the bodies are not read."""
    return (landings.select(WS, _path(), "landing", "page", "pages").groupBy(*_PAGE)
            .agg(F.count(F.lit(1)).alias("copies"), F.max("pages").alias("pages")))


def page_sets(landings: DataFrame) -> DataFrame:
    """Per (workspace, endpoint, run): pages expected and landed, copies, and whether the run is complete."""
    inside = (F.col("page") >= 0) & (F.col("page") < F.col("pages"))
    sets = page_keys(landings).groupBy(*_SET).agg(
        F.max("pages").alias("pages"), F.count_if(inside).alias("landed"), F.sum(F.col("copies") - 1).alias("repeated"))
    return sets.withColumn("complete", F.coalesce(F.col("landed") == F.col("pages"), F.lit(False)))


def current_sets(landings: DataFrame) -> DataFrame:
    """The newest complete run of every (workspace, endpoint)."""
    return page_sets(landings).where("complete").groupBy(WS, "path").agg(
        F.max("landing").alias("landing"), F.max_by("pages", "landing").alias("pages"))


def current_pages(landings: DataFrame) -> DataFrame:
    """Payload rows ``(workspace_id, endpoint, page, body)`` of the newest complete runs, each page once."""
    newest = current_sets(landings).select(*[F.col(c).alias(f"_{c}") for c in (*_SET, "pages")])
    rows = landings.select(WS, "endpoint", _path(), "landing", "page", "body", "landed_at")
    kept = rows.join(newest, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SET] + [F.col("page") < F.col("_pages")], "left_semi")
    twice = page_keys(landings).where("copies > 1").select(*_PAGE)
    single = kept.join(twice, _PAGE, "left_anti").select(WS, "endpoint", "page", "body")
    last = F.max_by(F.struct("endpoint", "body"), F.struct("landed_at", F.xxhash64("body")))
    double = kept.join(twice, _PAGE, "left_semi").groupBy(*_PAGE).agg(last.alias("r"))
    return single.unionByName(double.select(WS, "r.endpoint", "page", "r.body"))


def landing_report(landings: DataFrame) -> DataFrame:
    """Per (workspace, endpoint): the run in use, the newest run begun, and what waits or was repeated."""
    sets = page_sets(landings)
    used = F.max(F.when(F.col("complete"), F.col("landing")))
    return sets.groupBy(WS, F.col("path").alias("endpoint")).agg(
        used.alias("landing_used"), F.max("landing").alias("landing_newest"), F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("complete")).alias("incomplete_runs"), F.sum("repeated").cast("bigint").alias("repeated_pages"),
    ).withColumn("stale", F.coalesce(F.col("landing_used") < F.col("landing_newest"), F.lit(True)))


def bucket_of(workspace: str | Column = WS) -> Column:
    """The folder bucket of a workspace in a landing table written by ``land_pages``."""
    return F.pmod(F.xxhash64(F.col(workspace).cast("long") if isinstance(workspace, str) else workspace), F.lit(BUCKETS)).cast("int")


def land_pages(pages: DataFrame, path: str) -> None:
    """Append landed rows under folders by workspace bucket, so a reader of some workspaces opens only theirs."""
    (pages.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LANDING_SCHEMA.fields])
     .withColumn("bucket", bucket_of()).write.mode("append").partitionBy("bucket").parquet(path))
