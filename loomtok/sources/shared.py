"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The tables written since the innermost :func:`scratch` began, outermost first.
_open: list[list[tuple[SparkSession, str]]] = [[]]


def ensure_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, or ``spark.checkpoint.dir``; a local master without either gets a temporary one."""
    context = spark.sparkContext
    if there := context.getCheckpointDir():
        return there
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomtok-")
    context.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` computed once and written to the shared folder as Parquet, and read from there: its lineage is cut.

    The table goes when the :func:`scratch` around the call ends, or else with the session. ``instead_of`` is a table of
    an earlier call that nothing reads any more, as the last round of a loop; it goes now.
    """
    spark = df.sparkSession
    folder = f"{ensure_folder(spark).rstrip('/')}/loomtok-{uuid.uuid4().hex}"
    _open[-1].append((spark, folder))
    df.write.parquet(folder)
    if instead_of is not None:
        drop(instead_of)
    out = spark.read.schema(df.schema).parquet(folder)
    out._loomtok_folder = folder  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes the table of :func:`settled` that ``df`` reads, if it is what that returned."""
    if folder := getattr(df, "_loomtok_folder", None):
        for held in _open:
            held[:] = [(s, f) for s, f in held if f != folder]
        delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`settled` writes within are deleted at the end, also after an error. What reads them must have run by then."""
    _open.append([])
    try:
        yield
    finally:
        _clear(_open.pop())


def _clear(held: list[tuple[SparkSession, str]]) -> None:
    for spark, folder in held:
        with contextlib.suppress(Exception):  # the session may be gone; its folder goes with the cluster then
            delete(spark, folder)


@atexit.register
def _at_exit() -> None:
    for held in _open:
        _clear(held)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of a few files on as many cores as there are. One of more files or splits passes as it is.

    Only for what nothing was done to but reading: to count the partitions of a plan with a shuffle is to run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores * 2) if scan.rdd.getNumPartitions() < cores * 2 else scan
