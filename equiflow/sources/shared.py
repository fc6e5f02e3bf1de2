"""Tables that outlive executors: written to the folder that the cluster names, read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir, which cuts its lineage; removed when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isDefined():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or f"file://{tempfile.mkdtemp(prefix='equiflow-')}")  # one machine, as in tests
        named = sc._jsc.sc().getCheckpointDir()
    path = f"{named.get()}/equiflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def exists(spark, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_text(spark, path: str, text: str) -> None:
    """A small text file (a report) in whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
