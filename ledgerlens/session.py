"""Session construction and lineage cutting.

``materialize`` writes an intermediate result as Parquet under the shared
folder named by ``spark.checkpoint.dir`` and reads it back.  That cuts the
lineage between matching passes (plans stay small, and a lost executor
recomputes from the written files instead of from the raw inputs).  The
folder is read from the session; a private one under ``/tmp`` is only chosen
when the setting is missing *and* the master is local (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL_CKPT: dict[str, str] = {}


def get_spark(master: str | None = None, app: str = "ledgerlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the settings the library assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Order: ``spark.checkpoint.dir`` from the session, then the SparkContext
    checkpoint dir; only on a local master a private temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running ledgerlens jobs")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp")
    return _LOCAL_CKPT[key]


def new_run_dir(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder for one job's outputs (never reused, never cleared)."""
    return os.path.join(checkpoint_root(spark), "ledgerlens", f"{label}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "part", run_dir: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the re-read frame."""
    spark = df.sparkSession
    path = os.path.join(run_dir or new_run_dir(spark, "tmp"), name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create_file(spark: SparkSession, path: str, content: str) -> bool:
    """Make the file with its whole content, unless one of that name is there: False then.

    The content is written under a hidden name first, so a reader never sees a
    part of it; the name is taken in one step that fails if it exists (a hard
    link on a local disk, a rename without overwriting elsewhere)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    conf, target = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":
            to_local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(to_local(target), to_local(hidden))
        else:
            none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(hidden, target, none)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(hidden, False)


def with_dense_ids(df: DataFrame, order: list[str], id_col: str, base: int = 0, most: int | None = None) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, ... in the order of ``order`` (nulls
    first).  Rows are dealt out by range and numbered inside each range; the
    ranges' sizes (one row a range) give each range's offset, so no task sees
    more than one range.  Rows equal in all of ``order`` are numbered in any way.
    More than ``most`` rows raise OverflowError before any is numbered."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = materialize(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranged")
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], base
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    if most is not None and total - base > most:
        raise OverflowError(f"{total - base} rows, but room for {most}")
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, base)], "__range int, __start long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return (ranged.withColumn("__place", place).join(offsets, "__range")
            .withColumn(id_col, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start"))


def cluster_conf(input_bytes: int, total_cores: int, executor_memory_gb: int = 16,
                 target_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster sized from the input volume.

    * ``spark.sql.files.maxPartitionBytes``: input splits of ~target MB.
    * ``spark.sql.shuffle.partitions``: enough partitions that a shuffle
      partition of the widest stage (about the input size: the passes carry
      five narrow columns, far less than the input) stays near the target,
      and at least 3x the cores; AQE coalesces small ones and splits skewed
      ones at runtime.
    * broadcast thresholds stay at the defaults (AQE decides from runtime
      sizes); only tables with a proven bound are hinted in code.
    """
    mb = 1024 * 1024
    parts = max(3 * total_cores, -(-input_bytes // (target_partition_mb * mb)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_mb * mb),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_mb * mb // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_mb * mb),
        "spark.sql.session.timeZone": "UTC",
        "spark.executor.memory": f"{executor_memory_gb}g",
    }
