"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "taxoflow", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC, AQE and skew handling on; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, which all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only where that is unset (local tests)
    a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="taxoflow-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, watched: Observation | None = None, **metrics: Column) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint; the metrics are gathered by the same job."""
    shared_folder(df.sparkSession)
    return (df.observe(watched, *[m.alias(n) for n, m in metrics.items()]) if watched is not None else df).checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for new files in the shared folder, removed when the session ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{files.makeQualified(folder).toString()}/rows"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a compressed table in the shared folder, removed when the session ends.

    Unlike a checkpoint it is read by column, and repeated values take little room.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit by which operators size explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
