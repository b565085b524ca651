"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (a local master, as in tests) a
    temporary folder is made and set. On a cluster an unset folder is an error, since each machine
    would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tollgate-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Tables written by this process and not yet deleted, by the id of its session's application.
_WRITTEN: dict[str, str] = {}


#: Deletes the shuffle files of a plan when it has run. Otherwise they stay until the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: only its own table is read later."""
    old = spark.conf.get(_SWEEP)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, old)


def materialize(df: DataFrame, tag: str, repeats: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. Values that ``repeats`` are written as a dictionary."""
    path = f"{shared_dir(df.sparkSession)}/tollgate-{tag}-{uuid.uuid4().hex}"
    # Ids, hashes and texts seldom repeat, and a table is read once or twice: dictionaries of them cost more than they save.
    with swept(df.sparkSession):
        df.write.option("parquet.enable.dictionary", str(repeats).lower()).parquet(path)
    _WRITTEN[path] = tag
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def gather(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` for what is far smaller than what it is made from: its rows move once more, into few files instead of one a task."""
    return materialize(df.hint("rebalance"), tag)


def _delete(spark: SparkSession, path: str) -> bool:
    _WRITTEN.pop(path, None)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def discard(df: DataFrame) -> bool:
    """Delete the table of a materialised ``df``, whose rows no DataFrame still needs."""
    path = getattr(df, "written_at", None)
    return path in _WRITTEN and _delete(df.sparkSession, path)


class Scope:
    """The tables materialised between two points: ``with Scope(spark) as s: ...``, then ``s.release()`` once their rows are used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, ()

    def __enter__(self) -> Scope:
        self.before = set(_WRITTEN)
        return self

    def __exit__(self, *_: object) -> None:
        self.paths = tuple(p for p in _WRITTEN if p not in self.before)

    def release(self, used: Iterable[str] = ()) -> int:
        """Delete these tables and no others, but for those that hold one of the files ``used``; their number."""
        names = {p.rsplit("/", 1)[-1] for p in self.paths}
        held = {part for f in used for part in f.split("/") if part in names}
        return sum(_delete(self.spark, p) for p in self.paths if p in _WRITTEN and p.rsplit("/", 1)[-1] not in held)


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has materialised, once no DataFrame made from them is needed; their number."""
    return sum(_delete(spark, p) for p in list(_WRITTEN))
