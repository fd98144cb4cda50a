"""Session, table access and lineage cuts.

Nothing here assumes a local disk: intermediate tables and checkpoints go to
the folder the cluster names in ``spark.checkpoint.dir``.  Only where that is
unset and the master is local (tests, notebooks) a temporary folder is made.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import fields, is_dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution on; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ready for checkpoints."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if folder:
        if current is None:
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="strandwise-")
        sc.setCheckpointDir(current)
    # Spark appends its own subfolder to the directory that was set.
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read again.

    Column pruning and predicate pushdown apply to every later read, and the
    optimizer starts afresh: no statistics or constraints of earlier steps pile
    up, which makes this the form for iterative plans.
    """
    return Scratch(df.sparkSession).keep(df)


#: Folders of the intermediate tables that are still there, oldest first.
_MADE: list[str] = []


def release(spark: SparkSession, since: int, keep: list[DataFrame]) -> None:
    """Delete the intermediate tables made since then that none of ``keep`` reads."""
    held = {name for df in keep for f in df.inputFiles() for name in re.findall(r"/(table-[0-9a-f]{32})/", f)} if len(_MADE) > since else set()
    stay = [p for p in _MADE[since:] if os.path.basename(p) in held]
    files = Files(spark)
    for p in _MADE[since:]:
        if p not in stay:
            files.delete(p)
    _MADE[since:] = stay


def _frames(value: object) -> list[DataFrame]:
    if isinstance(value, DataFrame):
        return [value]
    if isinstance(value, (tuple, list)):
        return [f for v in value for f in _frames(v)]
    return [f for x in fields(value) for f in _frames(getattr(value, x.name))] if is_dataclass(value) else []


def scoped(make: Callable) -> Callable:
    """Intermediate tables of a call go when it returns, but those its result reads."""

    @wraps(make)
    def run(*args, **options):
        since = len(_MADE)
        out = make(*args, **options)
        frames = _frames(out)
        if frames and len(_MADE) > since:
            release(frames[0].sparkSession, since, frames)
        return out

    return run


@contextmanager
def tables_of_call(spark: SparkSession) -> Iterator[None]:
    """All intermediate tables made inside go at its end, as their results are written elsewhere."""
    since = len(_MADE)
    try:
        yield
    finally:
        release(spark, since, [])


class Scratch:
    """Intermediate parquet tables in the shared folder; see :func:`scoped` for how long they stay."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_dir(spark)

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = os.path.join(self.folder, f"table-{uuid.uuid4().hex}")
        df.write.parquet(path)
        _MADE.append(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[1]

    def counted(self, df: DataFrame, condition: Column | None = None) -> tuple[str, DataFrame, int]:
        """As :meth:`write`, with the number of rows (that meet ``condition``), counted as they are written."""
        seen = Observation()
        one = F.count(F.lit(1)) if condition is None else F.count(F.when(condition, 1))
        path, table_ = self.write(df.observe(seen, one.alias("n")))
        return path, table_, int((seen.get or {}).get("n") or 0)

    def drop(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        Files(self.spark).delete(path)
        if path in _MADE:
            _MADE.remove(path)


class Files:
    """Small files and folders on whatever file system the cluster uses for a path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)

    def listed(self, path: str, prefix: str = "") -> list[str]:
        """Files of a folder whose names begin with ``prefix``, in order of name."""
        system, where = self._at(path)
        found = [x.getPath() for x in system.listStatus(where) if x.getPath().getName().startswith(prefix)]
        plain = lambda x: x.toUri().getPath() if x.toUri().getScheme() in (None, "file") else x.toString()
        return sorted(plain(x) for x in found)

    def describe(self, path: str) -> tuple[str, int, int]:
        """Full path, bytes and time of change of a file."""
        system, where = self._at(path)
        found = system.getFileStatus(where)
        return found.getPath().toString(), found.getLen(), found.getModificationTime()

    def write(self, path: str, text: str) -> None:
        system, where = self._at(path)
        out = system.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        system, where = self._at(path)
        stream = system.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def shuffle_width(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` so that a task holds about ``rows_per_task``."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // max(1, rows_per_task)))
