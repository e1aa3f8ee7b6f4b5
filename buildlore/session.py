"""Session set-up and the one way this package cuts lineage: a table written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple, tuple[DataFrame, str]] = {}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("buildlore")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.files.minPartitionNum", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="buildlore-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def write_table(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """Write `df` once into the shared folder and return a reader over it, with its location.

    Unlike `checkpoint()` the plan runs once instead of twice, and what comes back is a columnar scan, so later column
    pruning and filters still reach the files. Losing executors cannot lose it.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/buildlore-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    return spark.read.schema(df.schema).parquet(place), place


def materialize(df: DataFrame) -> DataFrame:
    return write_table(df)[0]


def drop_table(spark: SparkSession, place: str) -> None:
    """Remove a table that `write_table` made and nothing reads any more."""
    if "/buildlore-" not in place:
        raise ValueError(f"not a table of this package: {place}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _stamp(spark: SparkSession, location: str) -> tuple:
    """Name, size and time of every file below a folder: what a table built from it depends on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def staged(spark: SparkSession, name: str, location: str, build) -> DataFrame:
    """Build an intermediate table once per session and state of the input folder, then share it between the plans that need it.

    If the folder's files have changed, the table is built anew; the old one goes with `forget`, as a plan may still read it.
    """
    key = (spark.sparkContext.applicationId, f"{name}@{location}", _stamp(spark, location))
    if key not in _STAGED:
        _STAGED[key] = write_table(build())
    return _STAGED[key][0]


def forget(spark: SparkSession) -> None:
    """Drop every staged table of this session; for callers that have read their results."""
    for key in [k for k in _STAGED if k[0] == spark.sparkContext.applicationId]:
        drop_table(spark, _STAGED.pop(key)[1])
