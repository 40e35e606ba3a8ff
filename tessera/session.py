"""Session and table loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that every plan here wants.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the session's checkpoint folder.

    Where neither is set, a temporary folder is made if the master is local, so that one machine is all there is; else it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, name: str):
    """A path and its file system, as Spark sees them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared folder; what it holds goes when the application ends."""
    where = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    path, files = hadoop_path(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: all later readers see the same rows, whichever executors are lost."""
    path = f"{scratch_path(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
