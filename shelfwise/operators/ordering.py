"""Global positions, sections and paging over an ordered result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to this estimated size one task orders everything; beyond it positions come from range partitions.
SMALL_BYTES = 64 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    Only in local mode, where there is one machine, a temporary folder serves where no checkpoint folder is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="shelfwise-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_position(df: DataFrame, order: list[Column], name: str = "pos", small: int = SMALL_BYTES, size: int | None = None) -> DataFrame:
    """Each row's 0-based place in the total order, as a long. ``size``: the input's bytes, where a join hides them.

    A large input is range-partitioned on the order and written; each partition numbers its own rows and adds the rows
    of the partitions before it, which is a table of one row per partition. No task sees more than one range.
    """
    if (estimated_bytes(df) if size is None else size) <= small:
        out = df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
        out._one_task = True
        return out
    ranged = written(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__pid").alias("__p"), (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(*order)) - 1
    out = ranged.withColumn("__own", own).join(F.broadcast(before), F.col("__pid") == F.col("__p"))  # one row per partition
    return out.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__pid", "__p", "__own", "__before")


def natural_key(name: Column) -> Column:
    """A string that sorts names with runs of digits by number: ``7`` and ``007`` are equal, ``9`` comes before ``10``."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def coded(run: Column) -> Column:
        bare = F.regexp_replace(run, "^0+", "")
        return F.when(F.regexp_like(run, F.lit("^[0-9]")), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(run)

    return F.array_join(F.transform(runs, coded), "")


def page(ordered: DataFrame, offset: int, count: int, pos: str = "pos") -> DataFrame:
    """Rows [offset, offset + count), clamped to the result."""
    return ordered.filter((F.col(pos) >= max(offset, 0)) & (F.col(pos) < max(offset, 0) + max(count, 0)))


def neighbours(ordered: DataFrame, key: str, value, radius: int, pos: str = "pos") -> DataFrame:
    """Rows within ``radius`` places of the row whose ``key`` is ``value``, nearest first, the later one before the earlier."""
    at = ordered.filter(F.col(key) == value).select(F.col(pos).alias("__at")).limit(1)
    near = ordered.join(F.broadcast(at), F.abs(F.col(pos) - F.col("__at")).between(1, radius))  # one row
    away = F.col(pos) - F.col("__at")
    return with_position(near.withColumn("away", away), [F.abs("away"), F.desc("away")], "rank").drop("__at")


def folder_offsets(ordered: DataFrame, folder: str = "folder_path", pos: str = "pos") -> DataFrame:
    """(folder, offset): the place where each folder is first reached."""
    return ordered.groupBy(folder).agg(F.min(pos).alias("offset"))


def folder_at(ordered: DataFrame, offset: int, folder: str = "folder_path", pos: str = "pos") -> DataFrame:
    """All rows of the folder of the row at ``offset``; none past the end."""
    at = ordered.filter(F.col(pos) == offset).select(F.col(folder).alias("__at")).limit(1)
    return ordered.join(F.broadcast(at), F.col(folder).eqNullSafe(F.col("__at")), "left_semi")  # one row


def sections(ordered: DataFrame, key: Column, taken: str, pos: str = "pos") -> DataFrame:
    """Runs of equal ``key`` in the order: key, offset, count and oldest.

    A run's start is found by comparing neighbours within fixed stretches of positions; a stretch's first row is
    compared with the last of the stretch before it, so no task needs the whole order. An order that one task has made
    is cut by one task.
    """
    if getattr(ordered, "_one_task", False):
        w = Window.orderBy("pos")
        rows = ordered.select(F.col(pos).alias("pos"), key.alias("key"), F.col(taken).alias("taken"))
        new = F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(~F.col("key").eqNullSafe(F.lag("key").over(w)))
        runs = rows.withColumn("new", new).withColumn("run", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy("run").agg(F.first("key").alias("key"), F.min("pos").alias("offset"), F.count("*").alias("count"), F.min("taken").alias("oldest")).drop("run")
    stretch = 1 << 20
    rows = written(ordered.select(F.col(pos).alias("pos"), key.alias("key"), F.col(taken).alias("taken")), "sections").withColumn("part", F.floor(F.col("pos") / stretch))
    edge = rows.filter(F.col("pos") % stretch == stretch - 1).select((F.col("part") + 1).alias("part"), F.col("key").alias("edge"), F.lit(True).alias("known"))
    w = Window.partitionBy("part").orderBy("pos")
    rows = rows.join(edge, "part", "left")
    first = F.row_number().over(w) == 1
    changed = F.when(first, F.when(F.col("known"), ~F.col("key").eqNullSafe(F.col("edge"))).otherwise(F.lit(True))).otherwise(~F.col("key").eqNullSafe(F.lag("key").over(w)))
    marked = rows.withColumn("start", changed)
    # Every row belongs to the last start at or before it; a stretch without one continues an earlier stretch's run.
    marked = marked.withColumn("run", F.last(F.when(F.col("start"), F.col("pos")), ignorenulls=True).over(w))
    runs = marked.groupBy("part", "run").agg(F.min("pos").alias("offset"), F.count("*").alias("count"), F.min("taken").alias("oldest"), F.first("key").alias("key"))
    by_part = runs.groupBy("part").agg(F.max("run").alias("last_run"))
    carry = by_part.select((F.col("part") + 1).alias("part"), F.last("last_run", ignorenulls=True).over(Window.orderBy("part")).alias("carried"))
    runs = runs.join(carry, "part", "left").withColumn("run", F.coalesce("run", "carried"))
    return runs.groupBy("run").agg(F.min_by("key", "offset").alias("key"), F.min("offset").alias("offset"), F.sum("count").alias("count"), F.min("oldest").alias("oldest")).drop("run")
