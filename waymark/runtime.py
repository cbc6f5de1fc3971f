"""Session helpers shared by the engine: scratch tables, code shipping, local sessions."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, list[str]] = {}
_scopes: list[Scope] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset a local master gets a
    temporary folder; any other master is refused, since a machine-local folder would be wrong there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    own = Path(tempfile.gettempdir()) / f"waymark-{app}"
    own.mkdir(parents=True, exist_ok=True)
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/scratch-{app}/{name}-{uuid.uuid4().hex[:12]}"
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(_clean, spark, app)
    _scratch[app].append(path)
    if _scopes:
        _scopes[-1].paths.append(path)
    return path


class Scope:
    """Scratch tables that are made within it go at its end, but for those that are kept.

    What is returned from within must only read kept tables.  Shuffle files of the finished stages go too, as soon
    as the driver sees that nothing reaches them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._waymark_path)
        return df

    def discard(self, *still: DataFrame) -> None:
        """Remove what was made so far, but for what is kept and what is ``still`` needed."""
        left, needed = [], self.kept | {df._waymark_path for df in still}
        for path in self.paths:
            if path in needed:
                left.append(path)
            else:
                delete_path(self.spark, path)
                _scratch[self.spark.sparkContext.applicationId].remove(path)
        self.paths = left
        release(self.spark)

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scopes.remove(self)
        if kind is None:
            self.discard()
        if _scopes:
            _scopes[-1].paths += self.paths


def release(spark: SparkSession) -> None:
    """Let the driver notice that finished stages are unreachable, so that their shuffle files go now and not later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``written``, and never broadcast if it is large."""
    size_files(df.sparkSession)
    out = written(df, name)
    path = out._waymark_path
    out = shuffled_if_large(out, path)
    out._waymark_path = path
    return out


#: How many bytes of rows a byte of a file may stand for.
INFLATION = 40


def size_files(spark: SparkSession) -> None:
    """Let plans take files for as large as their rows may be in memory, unless the session says otherwise.

    Hints don't pass unions and aggregates; this holds there.  What is truly small is still broadcast, by the measured size
    of its shuffle.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1.0")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(INFLATION)))


#: Scratch tables of more rows, or of more bytes, are never collected by the driver for a join.
LARGE_ROWS = 50_000
LARGE_BYTES = 1_000_000


def shuffled_if_large(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads ``path``, with a hint against broadcasts if it is large.

    Spark takes a table for as large as its files.  Rows of queries repeat, so that files below the size of a broadcast
    may hold millions of rows, which the driver would collect; so rows are counted, by the files' footers.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    if size < LARGE_BYTES and df.count() < LARGE_ROWS:
        return df
    logical = jvm.org.apache.spark.sql.catalyst.plans.logical
    never = getattr(getattr(logical, "NO_BROADCAST_HASH$"), "MODULE$")
    plan = logical.ResolvedHint(df._jdf.logicalPlan(), logical.HintInfo(jvm.scala.Option.apply(never)))
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all tasks, where few bytes stand for much work; the number keeps small partitions from being merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean(spark: SparkSession, app: str) -> None:
    for path in _scratch.pop(app, []):
        try:
            delete_path(spark, path)
        except Exception:  # the session may have ended first
            return


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that workers can import it on any machine."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="waymark-zip-")) / "waymark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def ship_active() -> None:
    """``ship`` for column functions, which know no session but the active one."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = cores or os.cpu_count() or 1
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
