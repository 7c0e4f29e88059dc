"""What the operators of this subpackage share: scratch tables, workers' caches, columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import pickle
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folders of this process that are still there, with the settings that open them; removed when it ends.
_MADE: dict[str, object] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a temporary folder is used.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='terrace-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the process ends, if not before."""
    path = f"{scratch_root(spark)}/terrace-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.unregister(_clean)
        atexit.register(_clean)
    _MADE[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return path


def remove_path(path: str) -> None:
    """Removes a scratch path, also after its session has stopped; what can't be opened any more is let be."""
    conf = _MADE.pop(path, None)
    if conf is not None:
        with contextlib.suppress(Exception):  # the driver's JVM is gone: the cluster's own cleaning has the rest
            where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def _clean() -> None:
    for path in list(_MADE):
        remove_path(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes the scratch tables that were made inside when it ends: results must have been written by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            remove_path(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, whatever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(table: DataFrame) -> None:
    """Removes a table that materialise() made and that nothing reads any more."""
    remove_path(table.scratch_path)


def quoted(name: str) -> str:
    """A column's name as an expression: names may hold dots and back ticks."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as a struct, so that no helper's name can clash with theirs; "row.*" gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")


def write_blocks(df: DataFrame, name: str, blocks: int) -> str:
    """df, whose column block is from 0 to blocks - 1, as a table in the shared folder that workers read a block at a time."""
    path = scratch_path(df.sparkSession, name)
    df.repartition(max(1, blocks), "block").write.partitionBy("block").parquet(path)
    return path


def file_system(uri: str):
    """pyarrow's file system of a path as Spark writes it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def read_block(path: str, block: int, columns: list[str]) -> list[tuple]:
    """On a worker: the rows of one block of a table that write_blocks() wrote."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, name = file_system(path)
    rows: list[tuple] = []
    for x in system.get_file_info(fs.FileSelector(f"{name}/block={block}", allow_not_found=True)):
        if x.path.endswith(".parquet"):
            with system.open_input_file(x.path) as stream:
                rows += zip(*(c.to_pylist() for c in pq.ParquetFile(stream).read(columns=columns).select(columns).columns), strict=True)
    return rows


def worker_cache(operator: str, name: str, make):
    """make() once per Python worker, kept from task to task while the worker runs the same operator.

    A worker serves many stages: what it keeps for one goes when it turns to another, and the memory that
    this leaves free goes back to the system, as the worker's next stage may need it elsewhere.
    """
    held = sys.modules.setdefault("_terrace_worker", types.ModuleType("_terrace_worker"))
    if getattr(held, "operator", None) != operator:
        held.operator, held.kept = operator, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
            ctypes.CDLL(None).malloc_trim(0)
    if name not in held.kept:
        held.kept[name] = make()
    return held.kept[name]


def ship(spark: SparkSession, thing):
    """A function that gives thing on a worker; by value, as a worker needn't know this package. Call it once a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
