"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows are whole documents here, so fewer of them go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def give_back() -> None:
    """What this process freed goes back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another allocator
        pass


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; when it ends, what it freed goes back to the system.

    Workers serve task after task, and the allocator would keep the most that any of them held.
    """

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='equiflow-')}"  # one machine, as in tests
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; removed when the driver ends.

    Unlike cached blocks the table survives a lost executor, and what is read back
    (row ids included) stays the same however often a task is repeated.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/equiflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(spark)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver collect its garbage if its heap takes over half of what it may.

    What led to a written table isn't needed any more; a heap left to grow takes all it may, and keeps it.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts are <= value, by binary search inside the expression.

    The cuts travel as one literal, so their number must be bounded by the caller.
    """
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    array = F.array(*[F.lit(c) for c in cuts]) if len(cuts) <= 64 else F.from_json(F.lit(str(list(cuts))), "array<bigint>")
    found = F.lit(0)
    size = len(cuts)
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        found,
        lambda at, step: F.when(
            (at + step <= size) & (F.get(array, F.least(at + step, F.lit(size)) - 1) <= value), at + step
        ).otherwise(at),
    )


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left join table on ``key`` (unique in table), where ``size`` says how many rows have the key.

    Keys with over 1/512 of all rows, 512 at most, are broadcast; their rows get a key of their own
    in the shuffle, so no task gathers them.
    """
    large = max(1000, total // 512)
    cols = [c for c in table.columns if c != key]
    hot = F.broadcast(table.filter(F.col(size) > large).select(F.col(key), F.struct(*cols).alias("_hot")))
    rest = table.filter(F.col(size) <= large).select(F.col(key).alias("_key"), F.struct(*cols).alias("_rest"), F.lit(0).cast("long").alias("_salt"))
    spread = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    joined = rows.join(hot, key, "left").withColumn("_salt", spread).withColumn("_key", F.col(key)).join(rest, ["_key", "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in cols])


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for every node that has one.

    Alternating large and small stars: every round hangs neighbours on the smallest one nearby,
    so the rounds grow with the logarithm of the longest path. Each round is a written table.
    """
    edges = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()
