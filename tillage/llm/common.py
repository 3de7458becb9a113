"""What the operators share: table access, Arrow maps, shared-folder cuts and broadcasts of checked size."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Largest pickled object that any operator here broadcasts.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def whole_text(column: str = "text"):
    """A text column as string; a column of another type (an all-null one is void) is cast."""
    return F.col(column).cast(StringType())


#: Rows of an Arrow batch where the session has no number of its own: texts are long, and a task holds a few batches.
BATCH_ROWS = 2000
_ROWS_KEY, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def release() -> None:
    """Give memory that is no longer used back to the system: a worker outlives its task and waits beside the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of bounded size, after which the worker's memory is released."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY, _SPARKS_OWN) == _SPARKS_OWN:
        conf.set(_ROWS_KEY, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def no_clash(extra: list[str] | None, results: set[str]) -> None:
    """Refuses extra columns that would come back under a result column's name."""
    if clash := results & set(extra or []):
        raise ValueError(f"extra columns have names of result columns: {sorted(clash)}")


def texts_of(column: pa.Array) -> Iterator[str]:
    """Strings one at a time, null as empty: a batch of long texts is never held twice."""
    for x in column:
        yield x.as_py() or ""


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text, null as empty."""
    for x in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield x.as_py() or b""


def broadcast(spark: SparkSession, value: Any, what: str):
    """Refuses what exceeds the bound, instead of growing with the data."""
    n = len(pickle.dumps(value, protocol=5))
    if n > MAX_BROADCAST_BYTES:
        raise ValueError(f"{what}: {n} bytes are more than may be broadcast ({MAX_BROADCAST_BYTES})")
    sent = spark.sparkContext.broadcast(value)
    release()  # of the driver: the pickles are gone
    return sent


#: Seconds between two collections of the driver's garbage, at least.
COLLECT_S = 5
_collected = 0.0


def collect(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage, as spark.cleaner.periodicGC.interval does: tables that were broadcast and
    shuffles that nothing refers to go then, and the heap need not grow for them."""
    global _collected
    if time.monotonic() - _collected >= COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local master may lack the setting."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="tillage-")
    spark.conf.set("spark.checkpoint.dir", d) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: one computation, no lineage, and it survives lost executors.

    Unlike checkpoint() this computes the last stage once and stores compressed columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release()
    collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut() that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys with a larger part of all rows than one in this many count as hot; there are no more than so many of them.
HOT = 4096


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread, how: str = "inner", hot: int | None = None) -> DataFrame:
    """rows joined (inner or left) to table, whose keys are unique, without bringing a hot key's rows into one task.

    table.weight is how many rows of a key there are, at least where it is hot; their sum over the table is `total`
    at most. Keys with over 1 / HOT of the total are then at most HOT, so they are broadcast; rows that met one, and
    rows with a null key, are dealt out by `spread` (a long) in the other join, where they have no partner.
    """
    n = hot or HOT
    few, many = table.where(F.col(weight) * n > total), table.where(F.col(weight) * n <= total)
    values = [c for c in table.columns if c not in keys]
    first = rows.join(F.broadcast(few.withColumnsRenamed({c: f"_hot_{c}" for c in values})), keys, "left")
    met = F.col(f"_hot_{weight}").isNotNull()
    alone = met
    for k in keys:
        alone = alone | F.col(k).isNull()
    place = F.xxhash64(*keys)  # not a constant, which the optimizer would fold out of the join's keys
    second = first.withColumn("_deal", F.when(alone, spread).otherwise(place))
    both = second.join(many.withColumn("_deal", place), [*keys, "_deal"], "left")
    if how == "inner":
        both = both.where(met | F.col(weight).isNotNull())
    return both.select(*rows.columns, *[F.when(met, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])
