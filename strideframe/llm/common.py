"""What the operators share: the shared scratch folder, written tables that cut lineage, and text columns as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents taken at a time inside a task, so that memory follows a few texts and not a whole Arrow batch.
SLICE = 256


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``. Where that is unset a local master gets a
    temporary folder, and a cluster, whose executors would not see one, an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`saved` returned and that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._scratch_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def row_of(df: DataFrame) -> Column:
    """All columns of a frame as one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def mapped_whole(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` with each task's batches passed through ``work``, which keeps its columns; they stand at their places, as the
    names of a frame may be such that Spark can't look them up."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(work, plain.schema).toDF(*df.columns)


def given_back() -> None:
    """Return to the system what Arrow's pool and the C library hold free: a worker lives on between tasks, beside its
    executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # in glibc
        trim(0)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, which gives back free memory after each batch that it returns and, its own variables gone, at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield out
            given_back()
        out = None
        given_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def text_portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``most`` bytes of their column ``text``, a longer text by itself."""
    for batch in batches:
        run = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // most
        cuts = np.r_[0, np.nonzero(np.diff(run))[0] + 1, batch.num_rows].tolist()
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a string column; null counts as empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in as_bytes(column)]


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of ``key``. A threshold on the hash, from the number of rows, comes before
    the sort, so that no more than about half as many again are ever sorted together."""
    share = min(1.0, (1.5 * most + 100) / max(df.count(), 1))
    drawn = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) <= int(share * (1 << 40)))
    return drawn.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(most)


def crc_mod(column: str, modulus: int):
    """crc32 of the column's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
