"""Session settings, the shared folder, and tables written to cut lineage."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session whose tasks run in the driver's own process
    (master `local`) may go without; elsewhere a folder of one machine would lose what others write, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lexmill-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan behind it runs once and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorting. Without the hint Spark rates a written or exploded table by its compressed bytes, many times
    too small, and may collect all of it on the driver to broadcast it."""
    return df.hint("merge")


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """As materialise, in n buckets of the key: joins and groups by it with tables of as many buckets need no shuffle."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    name = _name(path)
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def written() -> int:
    """How many tables this process has written, for release."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what was written to the shared folder after the first `since` tables, but for the last `keep`. Results
    still to be read need theirs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    upto = len(_written) - keep
    for path in _written[since:upto]:
        spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _written[since:upto]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
