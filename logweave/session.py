"""Session settings, shared work folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound on rows that are ever sent to every executor.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="logweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/logweave-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later stages never redo the work before it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, otherwise None.

    ``df`` should be settled first: the check runs a job over it.
    """
    fits = df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else None


def attach(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 64, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``big`` with ``small`` (unique on ``on``): broadcast while small, salted shuffle beyond.

    The salted form spreads each key of ``big`` over ``salts`` tasks by hashing the whole row, so one
    key holding a large share of the rows does not end up in one task. ``small`` is repeated per salt.
    """
    marked = small_side(small, max_rows)
    if marked is not None:
        return big.join(marked, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
