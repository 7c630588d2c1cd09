"""Helpers shared by the corpus operators: shipping code, stable stores, names."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`, as a character class body.
SPACE = r"\x20\x09-\x0D"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context.

    Worker functions are then found by module name, so caches that live in
    modules outlast a task.  The driver's file server distributes the archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_variantframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "variantframe_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._variantframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process (tests) a local one
    is made; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="variantframe_")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut, and a lost executor costs nothing that was stored.  Removed when the
    driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/variantframe/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder belongs to it
        pass


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text) -> F.Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text column; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def crc_mod(column, n: int) -> F.Column:
    """crc32 of the value as text, modulo n; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def least_frequency(table: DataFrame, most: int, n: str = "n", steps: int = 8) -> int:
    """The frequency from which on rows of ``table`` are at most ``most``, a step of a doubling's ``steps``-th part at a time; very high if even the first step has more."""
    step = F.floor(F.log2(F.col(n).cast("double")) * steps).cast("int")
    total, least = 0, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    found = None if least is None else table.where(step >= least).agg(F.min(n)).first()[0]
    return 1 << 62 if found is None else int(found)


def limit_threads() -> None:
    """One thread per Python worker: Spark already runs one task per core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def give_back() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict[Hashable, Any] = {}


def hold(key: Hashable, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker between tasks: tables and dictionaries.

    Workers outlive operators, so only one operator's things are kept: another
    key drops them first, and their memory goes back to the system.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]
