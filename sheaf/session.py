"""Session helpers: local sessions, the shared folder, checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.settings import BROADCAST_ROWS


def local_session(cpus: str = "*", app: str = "sheaf", **conf) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHEAF_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Long sessions compile many generated classes; keep room for them.
        .config("spark.driver.extraJavaOptions", "-XX:ReservedCodeCacheSize=512m")
        .config("spark.sql.ui.retainedExecutions", "10")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    They need it for the Arrow functions, wherever the driver was started from.
    """
    context = spark.sparkContext
    if any(os.path.basename(path) == "sheaf.zip" for path in context.listFiles):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sheaf-ship-"), "sheaf.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("sheaf", os.path.relpath(path, top)))
    context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster, where
    executors would each write to their own disk, its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sheaf-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sheaf/{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file with its whole content, or return False if there is one already.

    Of several writers, on any machines, one succeeds: the content is written aside and then
    linked or renamed to ``path``, which neither a local nor a Hadoop file system does over a file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    if files.getUri().getScheme() == "file":
        os.makedirs(target.getParent().toUri().getPath(), exist_ok=True)
        with open(aside.toUri().getPath(), "x", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside.toUri().getPath())
    out = files.create(aside, False)
    out.write(content.encode())
    out.close()
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, never_over)
        return True
    except Py4JJavaError as problem:
        files.delete(aside, False)
        if "FileAlreadyExistsException" not in problem.java_exception.toString():
            raise
        return False


@contextlib.contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def without_shuffle_files(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Writes of this block remove their shuffle files at their end, which else stay until the driver collects garbage."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For results several branches read: lineage is cut, the data survives lost
    executors, and each branch still reads only its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it holds at most ``max_rows``.

    Meant for narrow rows of keys. A larger input is returned as it is, and the
    join it goes into shuffles.
    """
    bound = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(df) if df.count() <= bound else df
