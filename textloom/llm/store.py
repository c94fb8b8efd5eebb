"""Where intermediate results of the operators live, and for how long.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir`` names: every executor and the
driver can read it, so a lost executor costs no recomputation. Only where that setting is missing (tests on one
machine) a temporary folder is chosen, and remembered in the session.

Tables that are settled inside `scratch` are deleted at its end; what must outlive it is `kept`, and then belongs to the
scratch around it, or to the caller, who can `drop` it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.shared.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    """By the store's own file system, whichever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it read back, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table that `settle` or `kept` returned; nothing that reads it may run any more."""
    _delete(df.sparkSession, df.settled_at)
    for scope in _scopes:
        if df.settled_at in scope:
            scope.remove(df.settled_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were settled in it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """`settle` for the scratch around this one."""
    own = _scopes.pop() if _scopes else None
    try:
        return settle(df, name)
    finally:
        if own is not None:
            _scopes.append(own)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Has Spark hand texts to Python in batches bounded by their bytes, unless the application sets a bound of its own: ten
    thousand long texts at a time, on both sides, are most of what a task holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, most)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, for parts of a bounded size: Catalyst's estimate, from the sizes of files, where it has one; else
    (it then says some exabytes) they are summed."""
    size = int(str(docs.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names for further columns: each as it is, or with as many underscores before it as it takes to be a new one."""
    seen = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return out


def whole(df: DataFrame) -> Column:
    """All columns of df as one, out of the way of others."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def among(docs: DataFrame, ids: DataFrame, on: str = "doc_id", bits: int = 26) -> DataFrame:
    """Rows of docs whose key `on` may be in ids, and all whose key is: those whose hash is marked in 2^bits bits, which
    are broadcast whatever the number of ids. More ids than that cost rows that a join drops later."""
    at = f"pmod(xxhash64({on}), {1 << bits}L)"
    marks = ids.groupBy(F.expr(f"{at} div 32768").alias("bucket")).agg(F.expr(f"bitmap_construct_agg({at} % 32768)").alias("marks"))
    byte = f"cast(conv(hex(substring(marks, cast({at} % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = f"{at} div 32768 = bucket and getbit({byte}, cast({at} % 8 as int)) = 1"
    return docs.join(F.broadcast(marks), F.expr(marked), "left_semi")
