"""Sessions, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Applications that have been given the package.
_given: set[str] = set()


#: Limits of Arrow batches, where the session has the usual ones: batches of long texts take several times their size.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def give_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they need not have it on their path."""
    context = spark.sparkContext
    for key, (usual, smaller) in BATCHES.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, smaller)
    if context.applicationId in _given:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(top):  # already running from an archive
        return
    target = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("pagewright", os.path.relpath(os.path.join(folder, n), top)))
    context.addPyFile(target)
    _given.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it names none there is one of our own, but only in
    local mode: on a cluster other executors could not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or os.path.join(tempfile.gettempdir(), 'pagewright-scratch')}/pagewright-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder, and read again: what uses it more than once does not compute it
    again, and executors may be lost."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
