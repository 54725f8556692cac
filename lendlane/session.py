"""Session set-up for local runs, and the one shared folder jobs may write to."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Deal out tables that come in one small file; for local runs.
SPREAD = "spark.lendlane.spread"


def local_session(cores: int | str = "*", app: str = "lendlane", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # The JVM never compiles a method of more than 8000 bytes of code; past
        # that, Spark does better without fusing the operators into one method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        # Small files of a single row group cannot be split at the scan; see `spread`.
        .config(SPREAD, "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table kept in one small file, where the session's setting asks for it.

    Such a file is read by a single task, and what follows would run on one core. On a
    cluster, tables are split at the scan: the setting is off unless it is switched on.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD, "false").lower() == "true"
    return df.repartition(spark.sparkContext.defaultParallelism) if wanted else df


def _reaches_all(master: str, folder: str) -> bool:
    """Whether a folder is on a store of its own, or all of the session on one machine."""
    scheme = folder.partition(":")[0] if ":" in folder else "file"
    return scheme != "file" or re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder named by `spark.checkpoint.dir`.

    A local session without the setting writes under its warehouse. So does one on a cluster, if the
    warehouse is no folder of the machine the driver runs on; otherwise it is refused, as executors would each see a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not _reaches_all(spark.sparkContext.master, warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{warehouse}/lendlane-scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
