"""What the operators share: words, the shared scratch folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Seconds that the driver's cleaner is given after a collection.
PAUSE = 0.5

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in a session of
    master ``local`` a folder below the warehouse is used, and on a cluster that is an error, as executors would
    not share it. What was written is removed when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    path = f"{root.rstrip('/')}/ringfold-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path.rpartition("/")[0]))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the scratch folder and reads it back: later steps neither
    recompute it nor depend on executors that may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path.rpartition("/")[0]
    return out


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps that run within send workers batches of as many rows at most; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(spark: SparkSession, tables: list[DataFrame] = []) -> None:  # noqa: B006
    """Removes kept tables that no later step reads, and lets Spark remove the shuffle files of steps whose results are
    written: it does so once the driver has collected their plans, which would otherwise wait for its memory to fill. A
    first collection leaves the last plan, which is let go of only after it; so there are two, with time to clean up."""
    for t in tables:
        if (path := getattr(t, "scratch", None)) is not None:
            _delete(spark, path)
            _made[:] = [m for m in _made if m[1] != path]
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(PAUSE)


#: Rows of one key beyond which it is joined apart, and as many such keys as a task may hold.
HOT_ROWS, HOT_KEYS = 5_000, 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once. Rows of keys that ``left`` has more than HOT_ROWS times
    stay where they are and meet right's rows of these keys as a broadcast, if these are HOT_KEYS at
    most (rows of fixed width are expected); the others, or all beyond that, are shuffled. left is read several times."""
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(key).limit(HOT_KEYS + 1)
    hot = kept(hot, "hot")
    if not 0 < hot.count() <= HOT_KEYS:
        return left.join(right, key, how)
    few = F.broadcast(hot)
    apart = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return apart.unionByName(left.join(few, key, "left_anti").join(right, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that isn't among the given ones."""
    name, taken = f"_{name}", {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(c: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text as an array, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def lowered(text: str | None) -> bytes:
    """UTF-8 of the text with only A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""
