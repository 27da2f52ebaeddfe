"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Runtime settings that results and speed depend on.
SETTINGS = {
    # Windows and naive timestamps are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above 8000 bytes of bytecode; a wide
    # projection fused into one method would be interpreted. Beyond the limit
    # Spark splits the projection into several methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Shuffle files are deleted at the end of the statement that wrote them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "flowloom") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    Taken from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). Only a local-mode session without one gets a
    scratch folder; a cluster without one is a configuration error, because a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    A lost executor then costs a re-read, not a recomputation. Unlike a row
    checkpoint the table is columnar: later steps read only what they need, and
    its size is known to the optimizer. The shuffle files behind the table are
    deleted when it stands, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    for written in _open:
        written.append(path)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`cut_lineage` that nothing reads again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stage-" in folder:
            delete(df.sparkSession, folder)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Delete all tables that :func:`cut_lineage` writes inside the block when it
    ends. For jobs that store their result before that."""
    _open.append(written := [])
    try:
        yield
    finally:
        _open.remove(written)
        for path in written:
            delete(spark, path)
