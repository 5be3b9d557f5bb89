"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime settings every job relies on: instants are UTC, plans adapt at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Window work here is heavy per byte, so small stages keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


_LOCAL_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "barworks", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than planning where expressions are built by the hundred.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    On a cluster it is whatever ``spark.checkpoint.dir`` names. Only a local master, where driver
    and executors are one process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="barworks-")
    return _LOCAL_DIRS[app]


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a result that several later stages read, and read it back.

    The rows go to the shared folder as Parquet: they are computed once, survive lost executors,
    and later stages still prune columns and know the size of the table.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, total: Column) -> tuple[DataFrame, object]:
    """:func:`materialize`, and an aggregate of the rows that is taken while they are written."""
    seen = Observation()
    stored = materialize(df.observe(seen, total.alias("total")))
    return stored, seen.get["total"]
