"""Pieces that several training-data operators share: scratch tables, word hashes, mergeable count tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A Spark/Java/DuckDB pattern for one word: the ASCII blanks separate words.
WORD = r"[^\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own if that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sedge-")
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs one task, not the job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sedge-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def tidy(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs now, not when the driver next collects garbage."""
        release()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            if path := self.paths.pop(id(df), None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


_caches: dict[str, list[Callable[[], None]]] = {}
_at_work: list[str] = []


def caches(owner: str, clear: Callable[[], None]) -> None:
    """Names a cache that a worker process keeps between tasks for an operator."""
    _caches.setdefault(owner, []).append(clear)


def working(owner: str) -> None:
    """Called by an operator's tasks: when a worker process turns to another operator, the others' caches end and their
    memory goes back, so a process that serves many operators holds the caches of one."""
    if _at_work == [owner]:
        return
    _at_work[:] = [owner]
    for name, clears in _caches.items():
        if name != owner:
            for clear in clears:
                clear()
    release()


def release() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def collect_executors(spark: SparkSession) -> None:
    """Has the JVM of each executor collect its garbage, so its heap shrinks to what is in use.

    Beside Python workers an executor's memory is short: a heap that an earlier job has grown stays as it is until it
    is full, and the workers of the next job come on top.  One short task a core, which idle executors get at once."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


class WordHashes(dict):
    """Word (UTF-8 bytes) -> 64-bit hash.  A cache of at most `most` words; the rest are hashed each time."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the text's words, A-Z lower-cased.  bytes.split() splits at exactly the ASCII blanks of WORD."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_words = WordHashes()
caches("words", _words.clear)


def word_hashes() -> WordHashes:
    """A worker process's one cache, for all operators on word hashes."""
    working("words")
    return _words


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k words, in text order; with fewer than k words, one for the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _M1 + words[j : n - k + 1 + j]
    out = (out ^ (out >> np.uint64(32))) * _M2
    return out ^ (out >> np.uint64(31))


# ---- count tables of a fixed size, added up over all tasks ----------------------------------------------------------

COUNT_ROW = T.StructType([T.StructField("task", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
_CHUNK = 1 << 16


def packed_counts(task: int, counts: np.ndarray) -> Iterator[dict]:
    """Rows of COUNT_ROW for one task's count table."""
    for at in range(0, len(counts), _CHUNK):
        part = counts[at : at + _CHUNK]
        if part.any():
            yield {"task": task, "chunk": at // _CHUNK, "counts": zlib.compress(part.astype("<i8").tobytes(), 1)}


def _sum_group(group: pa.Table) -> pa.Table:
    total = 0
    for x in group.column("counts").to_pylist():
        total = total + np.frombuffer(zlib.decompress(x), "<i8")
    return pa.table({"task": [group.column("up")[0].as_py()], "chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})


def summed_counts(rows: DataFrame, size: int, encode=lambda x: x, kind=np.int64, fan_in: int = 64) -> np.ndarray:
    """The sum of all tasks' tables as one array of `size` counts, each chunk turned by `encode` into `kind`.

    Tables are added up in a tree, at most `fan_in` in a group, so no task's input grows with the number of tasks; the
    driver gets size/65536 packed rows, whatever the input, and holds one array of `kind`.
    """
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        rows = rows.withColumn("up", F.floor(F.col("task") / fan_in)).groupBy("up", "chunk").applyInArrow(_sum_group, COUNT_ROW)
        tasks = -(-tasks // fan_in)
        if tasks <= 1:
            break
    out = np.zeros(size, kind)
    for r in rows.collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        out[r["chunk"] * _CHUNK :][: len(part)] = encode(part)
    return out
