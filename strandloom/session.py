"""Session-level helpers: shared checkpoint folder, lineage cuts, table access."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only where it is unset (tests) make one."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strandloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the files survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """Written once as a compressed table in the shared checkpoint folder and read back: smaller than a checkpoint, and columns
    that a reader doesn't need stay on disk."""
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df``, checkpointed, with the 0-based place of each row in ``order`` (total) over the whole table.

    Rows are range-partitioned by a sample, so that no key is sorted in one task; only the partitions' sizes come to the driver.
    """
    at = F.monotonically_increasing_id()  # partition << 33, plus the row's place in it
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row a partition
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors' Python workers, wherever they run."""
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_strandloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(path := os.path.join(folder, n), os.path.relpath(path, os.path.dirname(root)))
    shared = urlparse(spark.conf.get("spark.checkpoint.dir", None) or "")
    folder = shared.path if shared.scheme in ("", "file") and os.path.isdir(shared.path) else None
    with tempfile.NamedTemporaryFile(prefix="strandloom-", suffix=".zip", dir=folder, delete=False) as f:  # the driver serves it
        f.write(packed.getvalue())
    sc.addPyFile(f.name)
    sc._strandloom_shipped = True
