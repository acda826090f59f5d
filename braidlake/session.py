"""Session helpers: tables of a folder, partition counts, and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "braidlake") -> SparkSession:
    """A single-machine session for tests, the command line and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """`name`, with underscores put before it until no column has it (in any case), for columns that operators add."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fair_share(spark: SparkSession, most: float = 0.01, least: float = 1e-4) -> float:
    """Share of all rows from which a key is heavy: what one of the tasks of a shuffle would hold if they were all alike.

    Beyond 1 / least tasks it stays at `least`, which bounds the sketch; what a key below it holds is split by AQE.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return min(most, max(least, 1 / tasks))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset on a single machine, as in tests, an own one is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="braidlake-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so a lost executor loses none of it.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when the last plan that reads them does.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
