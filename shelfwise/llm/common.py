"""Helpers shared by the training-data operators: shared storage, size-checked joins, Arrow batches.

Everything an operator writes for itself goes below ``spark.checkpoint.dir``, the folder that driver and executors
share; an executor that is lost takes nothing with it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java and as an RE2 character class.
WS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, else its warehouse; only in local mode a temporary folder serves where none is named."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = sc.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="shelfwise-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shelfwise/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, and its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shelfwise_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, and let Spark drop the shuffles behind them."""
    sc = tables[0].sparkSession.sparkContext
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(t._shelfwise_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    sc._jvm.System.gc()  # shuffle files go when their plans are collected


def join_lookup(big: DataFrame, small: DataFrame, keys: list[tuple[str, str]], limit_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join of ``big`` with a written lookup table on null-safe keys ``(big column, small column)``.

    The lookup is broadcast only when its counted rows stay within ``limit_rows``; beyond that it is replicated
    ``salts`` times and both sides shuffle on keys plus salt, so one key holding a third of the rows is split.
    """
    on = None
    for b, s in keys:
        c = big[b].eqNullSafe(small[s])
        on = c if on is None else on & c
    if small.count() <= limit_rows:
        return big.join(F.broadcast(small), on, "left")
    salted = small.withColumn("__salt_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt_b", F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(salts)).cast("int"))
    on = left["__salt_b"] == salted["__salt_s"]
    for b, s in keys:
        on = on & left[b].eqNullSafe(salted[s])
    return left.join(salted, on, "left").drop("__salt_b", "__salt_s")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body`` (a lambda variable is never inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text: memory stays bounded, texts stay whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, total = 0, 0
        for i, s in enumerate(sizes):
            if i > start and total + s > max_bytes:
                yield _own(batch.slice(start, i - start))
                start, total = i, 0
            total += s
        yield _own(batch.slice(start)) if start else batch


def _own(part: pa.RecordBatch) -> pa.RecordBatch:
    """A slice with buffers of its own: Arrow's kernels misread some slices of text that start inside a buffer."""
    return part.take(pa.array(range(part.num_rows), pa.int64()))
