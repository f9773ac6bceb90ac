"""What the operators of this subpackage share: input columns, checkpoints, small Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanspark.storage import checkpointed, shared_folder  # noqa: F401  for the operators


#: The white space that ends a word or is stripped from a line.
BLANKS = " \t\n\x0b\x0c\r"
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SHINGLE_WORDS = 5
#: Bytes of one Arrow batch between the JVM and a Python worker; a worker holds a few of them at a time.
BATCH_BYTES = 4 << 20
#: Keys that a skewed join broadcasts are fewer than so many; rows (of tens of bytes) of which a task can hold all.
HOT_KEYS, SMALL_ROWS = 500, 1_000
#: Short rows (of tens of bytes) that are no work for more than one task.
ROWS_OF_A_TASK = 250_000


def bound_batches(df: DataFrame) -> DataFrame:
    """df; its session sends at most BATCH_BYTES at a time to Python workers, whatever the length of its texts.

    A smaller bound of the session stays. The bound is read when a query starts, so it stays set.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not str(now := conf.get(name)).isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, lengthened until no taken column is called like them in any case."""
    held = {x.lower() for x in taken}
    found = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return tuple(found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer read, in whatever store it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def drop_unused(spark: SparkSession) -> None:
    """Has the driver forget finished steps, so that Spark's cleaner deletes their shuffle files; for loops of many short steps."""
    spark.sparkContext._jvm.System.gc()


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many short rows, in no more partitions than they need."""
    return df.coalesce(max(1, -(-rows // ROWS_OF_A_TASK)))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, a checkpointed table, to be broadcast if it has at most so many rows; beyond that joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row per key and, in weight, how many of left's rows hold it (dropped).

    Keys of more than one in HOT_KEYS of left's rows, so fewer than HOT_KEYS of them whatever the data, are named and
    their rows of right broadcast; the rest are shuffled, so no task gathers the rows of a hot key. left of no more than
    SMALL_ROWS rows is shuffled whole.
    """
    named = [] if rows <= SMALL_ROWS else [r[0] for r in right.where(F.col(weight) * HOT_KEYS > rows).select(key).collect()]
    plain = right.drop(weight)
    if not named:
        return left.join(plain, key, how)
    hot = F.coalesce(F.col(key).isin(named), F.lit(False))
    return left.where(hot).join(F.broadcast(plain.where(hot)), key).unionByName(left.where(~hot).join(plain.where(~hot), key, how))


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def shared(sc: SparkContext, value) -> Broadcast:
    """A broadcast of a value whose class executors need not have installed; read it with unshared()."""
    return sc.broadcast(cloudpickle.dumps(value))


def unshared(sent: Broadcast):
    return cloudpickle.loads(sent.value)
