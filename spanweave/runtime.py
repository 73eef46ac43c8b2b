"""Session helpers: reading test tables, cutting lineage through written tables, and joins that hold with hot keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many, so there are never more hot keys than this and they may be broadcast.
HOT_SHARE = 10_000
_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder and any other an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spanweave-")
    return _LOCAL[app]


def scratch(spark: SparkSession, kind: str = "cut") -> str:
    """A new path in the shared folder; ``release`` removes what was written there."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files, which outlive lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """``df`` for more than one reading: itself if it only filters and projects a stored table, else written down."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.children().isEmpty() else cut(df)


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables written by ``scratch`` and ``cut``; frames that read them are void afterwards. Runs at the end of the program as well."""
    spark = spark or SparkSession.getActiveSession()
    if not spark or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        release()


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of an aggregate of one row beside every row, as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def hot_keys(counted: DataFrame, keys: list[str], n: str, rows: DataFrame) -> DataFrame:
    """The keys of ``counted`` (a row per key, its rows in column ``n``) that hold more than one in ``HOT_SHARE`` of ``rows``: fewer than that by arithmetic."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return counted.where(F.col(n) * HOT_SHARE > total).select(*keys)


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join on keys that are unique in ``small``. Rows of the ``hot`` keys (see ``hot_keys``) meet by broadcast where they lie; the others are shuffled."""
    hot = F.broadcast(hot)
    few = F.broadcast(small.join(hot, keys, "left_semi"))
    return big.join(few, keys).unionByName(big.join(hot, keys, "left_anti").join(small, keys))
