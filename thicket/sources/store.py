"""The node store: views that many queries read are written once, sorted by id, and read back.

Over the written table the filters on id, project and depth reach the Parquet
scan, whose row groups or pages hold narrow ranges of ids. A table is known by the files
it was made from: their paths, sizes and times, so changed data are written
anew. The folder is one that driver and executors share: the session's
``spark.checkpoint.dir``, else the context's checkpoint folder; only on a
single machine a temporary one is made, and removed when Python ends. On a
cluster with neither, a view stays a view.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (application, name, files) to the folder of what was written.
_written: dict[tuple, str] = {}
#: Temporary folders by application, on a single machine only.
_local: dict[str, str] = {}
#: Bytes of input for one file of output, about. A task sorts all rows of a file, which take some forty times as much in memory.
BYTES = 8 << 20
#: While a table is made, Spark joins small parts of shuffles up to this size only: compressed keys take far more in memory.
PART = "16m"
#: The same where tables stay dealt as they were made: a task then joins, numbers and sorts its rows.
DEALT = "8m"
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: What writing took: (name, seconds, bytes of input), in order.
spent: list[tuple[str, float, int]] = []


def files(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """(path, bytes, time) of the data files at some paths, on whatever file system they are."""
    found = []
    for path in paths:
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.listStatus(top):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def shared_folder(spark: SparkSession) -> str | None:
    """The session's checkpoint folder, or the context's; on a single machine a temporary one where none is set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="thicket-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        given = _local[app]
    return given


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts a loop's lineage in the session's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back, so that what reads it several times makes it once and reads only its columns; a stream or a session without a folder stays as it is."""
    folder = None if df.isStreaming else shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/thicket-kept-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    first = conf.get(_FIRST, None)
    # enough parts that none is too large for a task: as many as two to an input file
    conf.set(_FIRST, max(int(conf.get("spark.sql.shuffle.partitions")), 2 * len(df.inputFiles())))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_FIRST, first) if first is not None else conf.unset(_FIRST)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Spark joins small parts of shuffles up to PART only, unless the session asks for less or for another size; left so, as queries over the store run later."""
    if spark.conf.get(_ADVISED) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(_ADVISED, PART)


def pieces(spark: SparkSession, *inputs: str) -> int:
    """Into how many files the store writes what is made from the files at ``inputs``."""
    return max(1, -(-sum(n for _, n, _ in files(spark, *inputs)) // BYTES))


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame], order: str, *inputs: str, ranged: bool = True) -> DataFrame:
    """What ``make`` gives from the files at ``inputs``, as a table that is written at its first use and sorted by ``order``.

    A table that isn't ``ranged`` stays dealt to tasks as it was made, which
    spares a shuffle and the sampling before it; each file is sorted, so
    filters on ``order`` reach its pages instead of some files only.
    """
    source = files(spark, *inputs)
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _written:
        folder, made = shared_folder(spark), make()
        if folder is None:
            return made
        began, size = time.perf_counter(), sum(n for _, n, _ in source)
        path = f"{folder}/thicket-{name}-{uuid.uuid4().hex}"
        number = max(1, -(-size // BYTES))
        before, first = spark.conf.get(_ADVISED), spark.conf.get(_FIRST, None)
        spark.conf.set(_ADVISED, PART if ranged else DEALT)
        # enough parts that none is too large for a task, however much there is
        spark.conf.set(_FIRST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * number))
        try:
            dealt = made.repartitionByRange(number, order) if ranged else made
            dealt.sortWithinPartitions(order).write.parquet(path)
        finally:
            spark.conf.set(_ADVISED, before)
            spark.conf.set(_FIRST, first) if first is not None else spark.conf.unset(_FIRST)
        _written[key] = path
        spent.append((name, time.perf_counter() - began, size))
    return spark.read.parquet(_written[key])
