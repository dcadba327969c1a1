"""Re-assess workspaces as their configuration snapshots land.

The reference has no streaming semantics: an assessment is a point-in-time
snapshot. This module only schedules the same batch operators with Structured
Streaming: a file stream over the landed payload table feeds ``foreachBatch``,
which scores the workspaces that the micro-batch touches, from all their landed
pages, and writes their scores
under ``epoch=<id>`` with overwrite, so a replayed epoch (after a failure)
replaces its own output instead of duplicating it.

With ``landings`` the folder is a landing table (``sources.snapshots.land_pages``): pages carry
the collector run they belong to, runs may arrive over several batches, overlap or tear, and a
workspace is scored from its newest complete pages per endpoint. A micro-batch then opens only
the folder buckets of the workspaces that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetgrade.config import AssessConfig
from fleetgrade.plans.assess import assess
from fleetgrade.session import cut_lineage
from fleetgrade.sources.inventory import PAYLOAD_SCHEMA, inventory_tables
from fleetgrade.sources.snapshots import LANDING_SCHEMA, current_pages

WS = "workspace_id"


def score_batch(changed: DataFrame, landed: DataFrame, workspaces: DataFrame,
                operational: dict[str, DataFrame] | None, cfg: AssessConfig) -> DataFrame:
    """Scores of the workspaces that have payloads in ``changed``, from all their ``landed`` pages.

    Inputs are written once per call, so every rule reads that table and the operational
    sources are not scanned again per pillar.
    """
    present = cut_lineage(changed.select(WS).distinct(), "changed")
    payloads = landed.join(present, on=WS, how="left_semi")
    ws = workspaces.join(present, on=WS, how="left_semi")
    ops = ({k: v.join(present, on=WS, how="left_semi") for k, v in operational.items()}
           if operational else None)
    return assess(inventory_tables(payloads, ws), ops, cfg).scores


def touched_pages(spark: SparkSession, batch: DataFrame, payload_dir: str) -> DataFrame:
    """The current pages of the folder buckets that a batch of landed rows touches (at most ``BUCKETS`` numbers)."""
    buckets = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
    schema = T.StructType([*LANDING_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
    return current_pages(spark.read.schema(schema).parquet(payload_dir).where(F.col("bucket").isin(buckets)))


def start_rescoring(spark: SparkSession, payload_dir: str, workspaces: DataFrame,
                    operational: dict[str, DataFrame] | None, cfg: AssessConfig, out_dir: str,
                    checkpoint_location: str, available_now: bool = True, landings: bool = False) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what has landed and stops."""
    schema = T.StructType([*LANDING_SCHEMA.fields, T.StructField("bucket", T.IntegerType())]) if landings else PAYLOAD_SCHEMA
    stream = spark.readStream.schema(schema).parquet(payload_dir)

    def run(batch: DataFrame, epoch_id: int) -> None:
        # The batch only tells which workspaces changed; their pages may have landed over several batches.
        landed = (cut_lineage(touched_pages(spark, batch, payload_dir), "current-pages", ["endpoint"]) if landings
                  else spark.read.schema(PAYLOAD_SCHEMA).parquet(payload_dir))
        scores = score_batch(batch, landed, workspaces, operational, cfg)
        (scores.withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}"))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
