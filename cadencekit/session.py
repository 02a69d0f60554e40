"""Session helpers: sizing knobs, reliable checkpoints and plan-size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "spark.cadencekit.hotRows"
DEFAULT_HOT_ROWS = 4_000_000
SMALL_PLAN_BYTES = 64 * 1024 * 1024


def build_session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects everywhere."""
    return (
        SparkSession.builder.master(master)
        .appName("cadencekit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold before the key is cut."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def checkpoint_base(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that ``spark.checkpoint.dir`` names, which all machines of a
    cluster share.  Only a session on one machine may go without; it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_and_free(df: DataFrame) -> DataFrame:
    """``materialise``, after which the shuffles that led to the rows go from disk at once.

    Without it they stay until the driver's collector finds them unused, often for the rest of the job."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        # A new frame: each has the setting of the time when it was made.
        return materialise(df.select("*"))
    finally:
        conf.set(name, before)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, read from the optimised plan; estimates of nested joins have no bound,
    so beyond 2^60 they are all alike."""
    try:
        return min(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), 1 << 60)
    except ValueError:  # more digits than Python converts
        return 1 << 60


def sized_partitions(df: DataFrame, each: int = 32 * 1024 * 1024) -> int | None:
    """Partitions for a frame too small to need the session's number of them; None for others, which Spark sizes."""
    session = df.sparkSession
    wanted = max(session.sparkContext.defaultParallelism, plan_bytes(df) // each)
    return wanted if wanted < int(session.conf.get("spark.sql.shuffle.partitions")) else None


def surely_small(df: DataFrame) -> bool:
    """True when a whole frame is too small to hold a hot key at the default limit."""
    limit = hot_rows(df.sparkSession)
    return limit >= DEFAULT_HOT_ROWS and plan_bytes(df) <= SMALL_PLAN_BYTES
