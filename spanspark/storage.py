"""Tables and lineage cuts in the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which a cluster shares; only a local session without one (a test) gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanspark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_ordinals(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with running numbers from 0 in the given order, without gathering its rows in one task.

    The rows are range-partitioned and sorted; a partition's numbers start after the rows of the partitions before it,
    of which only the counts (one per partition) meet.
    """
    placed = checkpointed((df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


#: Bytes of one Arrow batch between the JVM and a Python worker, and rows that a worker gathers before it sends them.
BATCH_BYTES, ROWS_OUT = 4 << 20, 20_000


def bound_batches(df: DataFrame) -> DataFrame:
    """df; its session sends at most BATCH_BYTES at a time to Python workers, whatever the length of its sentences.

    A smaller bound of the session stays. The bound is read when a query starts, so it stays set.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not str(now := conf.get(name)).isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def one_by_one(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows' values of some columns; only one row at a time is made into Python objects."""
    for batch in batches:
        held = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in held)


def sent(rows: Iterable[Sequence], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ROWS_OUT."""
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    out: list[Sequence] = []
    for row in rows:
        out.append(row)
        if len(out) == ROWS_OUT:
            yield made(out)
            out = []
    if out:
        yield made(out)
