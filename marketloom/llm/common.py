"""Small helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A table of at most this many narrow rows (ids and numbers, under 64 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000


#: A word where punctuation doesn't count.
LETTERS = re.compile(r"[^\W_]+")


def words_of(text: str | None, letters: bool = False) -> list[bytes]:
    """The words between white space, lower-cased, in UTF-8; if letters, the runs of letters and digits."""
    low = (text or "").lower()
    return [w.encode() for w in LETTERS.findall(low)] if letters else low.encode().split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; raises where that is unset, as no local folder would do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


#: Paths stashed inside each open scratch(), innermost last.
_open: list[list[str]] = []


def stash(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and return a reader of it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what stash() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans: it does so when the driver collects garbage, which a loop of many small shuffles can wait long for."""
    spark._jvm.System.gc()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The stashed result of make(); whatever else was stashed for it is deleted."""
    _open.append([])
    try:
        out = stash(make())
    finally:
        paths = _open.pop()
    for path in paths:
        if path != out._stash_path:
            _delete(out.sparkSession, path)
    if _open:
        _open[-1].append(out._stash_path)
    return out


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df (stashed, so counting is cheap) has at most max_rows rows; else leave a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def widened(df: DataFrame, more: str) -> StructType:
    """df's schema with the fields of the DDL text `more` behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
