"""Tables that end a lineage, in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: The lists that take down what is written meanwhile, of this thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the one that spark.checkpoint.dir names; it goes when Python ends. Where that is unset a
    temporary one is set in local sessions, which have no other machine; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="genospark-")
        spark.conf.set("spark.checkpoint.dir", found)
    folder = f"{found.rstrip('/')}/genospark-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
    return folder


@atexit.register
def _left_folders() -> None:
    for folder, spark in _folders.items():
        with contextlib.suppress(Exception):  # the JVM may be gone
            removed(spark, [folder])


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and a lost executor costs
    no more than the stage at hand."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that this thread writes meanwhile."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these tables; what was made from them must be written itself."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def read_by(df: DataFrame) -> str:
    """The root paths of the files that df reads, as a text; no file is listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().mkString(" "))
    return " ".join(found)


def tidy(f: Callable) -> Callable:
    """f, whose tables are deleted at its end but for those that the DataFrames it returns read."""

    @wraps(f)
    def run(*args, **options):
        with collected() as made:
            out = f(*args, **options)
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        if made and frames:
            kept = " ".join(map(read_by, frames))
            gone = [path for path in made if path.rpartition("/")[2] not in kept]
            for scope in _scopes.get():
                scope[:] = [path for path in scope if path not in gone]
            removed(frames[0].sparkSession, gone)
        return out

    return run
