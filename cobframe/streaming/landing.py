"""Push-based landing zone as a Structured Streaming job.

A folder ``{root}/{date}/{cp}/{ns}`` is ingested when its sender has put the
marker file ``READY`` into it (any text; Spark's file scan passes over files
without a byte), after all other files: the agreement, the trades, the market
data, the matrix files and their list ``matrices.csv``.
Each micro-batch reads the folders it was told of and no others, runs the
ordinary ingest (validation, matrix verification, assembly, hashing) with the
already stored keys as ``existing_keys``, and appends to the store.  The
write-once rule is the anti-join against stored keys, not a watermark (a
watermark would forget old keys).  A micro-batch's logical id follows from the
markers it holds, so a replay of the same batch after a crash is the same
batch to the store, whatever checkpoint it runs under.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cobframe.operators.ingest import ingest_batch
from cobframe.operators.store import append_snapshots
from cobframe.plans.domain import work_stage
from cobframe.session import ensure_checkpoint_dir
from cobframe.sources.files import delete_tree, folder_files
from cobframe.sources.staging import (load_landing_csv, read_staging_agreements,
                                      read_staging_market_data, read_staging_trades)
from cobframe.sources.stores import read_matrix_manifest, read_snapshots

READY = "READY"
MARKER_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, landing_root: str, max_folders: int = 1000) -> DataFrame:
    """Streaming DataFrame of ready folders (``folder``: ``{date}/{cp}/{ns}``),
    ``max_folders`` to a micro-batch."""
    markers = (spark.readStream.format("binaryFile").schema(MARKER_SCHEMA)
               .option("maxFilesPerTrigger", max_folders)
               .load(f"{landing_root.rstrip('/')}/*/*/*/{READY}"))
    return markers.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)/[^/]+$", 1).alias("folder"),
                          "modificationTime")


def matrix_inputs(spark: SparkSession, landing_root: str, folders: list[str], present: set[str] | None = None):
    """The matrix files that have arrived in ready folders (named by their
    store path ``matrices/{date}/{cp}/{ns}/{file}``) and the senders' lists."""
    base = landing_root.rstrip("/")
    present = folder_files(spark, landing_root, folders) if present is None else present
    lists = [f"{base}/{f}/matrices.csv" for f in folders if f"{f}/matrices.csv" in present]
    if not lists:
        return None, None
    manifest = read_matrix_manifest(spark, lists)
    files = [f"{base}/{p}" for p in sorted(present) if p.endswith(".npy")]
    if files:
        found = spark.read.format("binaryFile").load(files)
    else:
        found = spark.createDataFrame([], MARKER_SCHEMA)
    path = F.concat(F.lit("matrices/"), F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1))
    return found.select(path.alias("path"), "length", "content"), manifest


def ingest_micro_batch(spark: SparkSession, landing_root: str, store_root: str):
    """foreachBatch body: ingest the ready folders of the batch (their names,
    ``max_folders`` at most, come to the driver)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ready = sorted((r["folder"], str(r["modificationTime"])) for r in batch.collect())
        if not ready:
            return
        name = hashlib.sha1("\n".join(map("|".join, ready)).encode()).hexdigest()
        folders = sorted({f for f, _ in ready})
        present = folder_files(spark, landing_root, folders)
        staged = load_landing_csv(spark, landing_root, folders=folders, present=present)
        files, manifest = matrix_inputs(spark, landing_root, folders, present)
        # the written intermediates let snapshots, trades and rejects share one reading of the files
        work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cobframe-landing-{uuid.uuid4().hex}"
        stage = work_stage(spark, work)
        agreements = stage("staged", staged["staging_agreements"])
        bounds = agreements.agg(F.min("cob_date").alias("low"), F.max("cob_date").alias("high")).first()
        result = ingest_batch(read_staging_agreements(agreements),
                              read_staging_trades(staged["staging_trades"]),
                              read_staging_market_data(staged["staging_market_data"]),
                              matrix_files=files, manifest=manifest,
                              # only the months of the batch's dates are read
                              existing_keys=read_snapshots(spark, store_root, bounds["low"], bounds["high"])
                              if bounds["low"] else None, stage=stage)
        unread = staged["landing_rejects"].select(
            "counterparty_id", "netting_set_id", F.col("cob_date").try_cast("date").alias("cob_date"),
            "reject_reason", F.concat_ws(" ", "table_name", "detail").alias("detail"))
        result = result._replace(rejects=result.rejects.unionByName(unread))
        append_snapshots(result, store_root, batch_id=f"stream-{name}")
        delete_tree(spark, work)
    return run


def start_landing_ingest(spark: SparkSession, landing_root: str, store_root: str,
                         checkpoint_location: str, available_now: bool = False,
                         interval: str = "1 minute") -> StreamingQuery:
    """Start the landing-zone ingest stream (``available_now`` processes what
    is there and stops, for scheduled runs and tests)."""
    writer = (landing_stream(spark, landing_root).writeStream
              .foreachBatch(ingest_micro_batch(spark, landing_root, store_root))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=interval)
    return writer.start()
