"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobframe.session import ensure_checkpoint_dir, ship_package


BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors, settle the shared folder, and bound
    the Arrow batches by bytes: rows here are whole texts, and the default of
    64 MB is held several times over in each task, on either side of the pipe."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get(BATCH_SETTING, "64m").lower().replace("m", "0" * 6).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage: a lost executor repeats nothing before this point, and what
    follows may read the rows as often as it likes.  The folder is the one
    ``spark.checkpoint.dir`` names, which every executor sees.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


_REMEMBERED: dict = {}


def remembered(key, make: Callable):
    """What a Python worker remembers between tasks (words it has met): one
    thing at a time, so that a worker passed from one operator to the next does
    not carry the memories of all."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
    return df.mapInArrow(run, schema)


def text_or_empty(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null read as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, column: str | int, max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows holding about ``max_bytes`` of text each, one row at least."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list, the
    component being its smallest node.

    Alternating stars: each round hangs every node below the smallest label it
    can see and then shortens the path by a jump, so chains shrink
    geometrically.  Only joins and minima on keys; a node with very many edges
    is pre-aggregated before the shuffle.  Each round is a written table in the
    shared folder.  A null on either side of an edge is ignored.
    """
    both = staged(
        edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b").distinct(), "edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("label")), "label")
    for _ in range(rounds):
        seen = (both.join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m")))
        low = label.join(seen, "node").select("node", F.col("label").alias("old"),
                                              F.least("label", "m").alias("low"))
        # hook: what a node's old label should at least fall to
        hook = low.groupBy(F.col("old").alias("h")).agg(F.min("low").alias("hl"))
        fresh = low.join(hook, F.col("low") == F.col("h"), "left").select(
            "node", "old", F.least("low", F.coalesce("hl", "low")).alias("label"))
        fresh = staged(fresh, "label")
        done = fresh.where(F.col("label") != F.col("old")).limit(1).count() == 0
        label = fresh.select("node", "label")
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select("node", F.col("label").alias("component"))
