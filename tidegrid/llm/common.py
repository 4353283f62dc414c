"""What the operators share: input tables, the shared folder, cut lineage, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hashes a Python worker keeps, for all operators together: some 25 MB.
KEPT_WORDS = 200_000
_written: dict[str, SparkSession] = {}
#: Clear what a Python worker keeps for further tasks of one operator: tasks of others have no use for it.
kept_by_tasks: list[Callable[[], None]] = []


class _Hashes(dict):
    def __missing__(self, word) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, as all other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as lower-cased (A-Z) UTF-8: bytes know only ASCII white space and case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def column_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of byte_words(), as strings, of all texts one after another, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    ends = np.cumsum(sizes)
    kept = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), kept[ends] - kept[ends - sizes]


def release_memory(*, others: bool = False) -> None:
    """Forgets kept words and gives back what a Python worker has freed, at the end of a task: Arrow and the C library would keep it, in each of several idle workers.

    others: forgets also what other operators' tasks have kept, as tokenizers with their pieces.
    """
    _hashes.clear()
    for clear in kept_by_tasks if others else ():
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words, as bytes or as strings. Words of one text alone can exceed the bound, until the next text."""
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one is made if driver and executors are one process; else that is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        spark.sparkContext._conf.set("spark.checkpoint.dir", where)
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget)
    _written[path] = spark
    return path


def forget(*paths: str) -> None:
    """Deletes tables and folders from new_path(); all of them if none is named."""
    for path in paths or list(_written):
        spark = _written.pop(path, None)
        if spark is not None:
            with contextlib.suppress(Exception):  # the session may have gone, and its folder with it
                jvm = spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, evaluates once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidegrid_path = path
    return out


def drop_written(df: DataFrame) -> None:
    forget(df._tidegrid_path)


def bounded_batches(spark: SparkSession, records: int = 2000, size: int = 16 << 20) -> None:
    """Rows that go to Python at once: so many, and so many bytes, at most. Long texts then don't pile up.

    The session keeps these settings, as results are evaluated after the operator returns.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if now <= 0 or now > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def filesystem(uri: str):
    """pyarrow's file system of a URI, and the path in it: file, s3, gs and hdfs alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def spread(rows: DataFrame, most: int = 20_000) -> int:
    """Tasks for rows that each stand for much work: one a row, up to a bound."""
    return max(1, min(most, rows.count()))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows, or about so many, whose hashes are least: the same in each run.

    A bound that the number of rows sets leaves about 1.2 n, which alone are sorted, by hash and keys. So,
    unlike orderBy(...).limit(n) over all rows, no task keeps, and the driver never gets, n rows of each partition.
    """
    share = 1.2 * n / max(1, df.count())
    hashed = F.xxhash64(*keys)
    place = hashed.cast("double") / 2.0**64 + 0.5
    return (df.where(place < share) if share < 1 else df).orderBy(hashed, *keys).limit(n)
