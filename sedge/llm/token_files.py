"""Token-ID files: Parquet list columns in ascending doc_id order, read back selectively."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm.common import caches, texts_of, working

#: Pre-tokens of both kinds in a generation of a worker's cache, which keeps two: when the young one is full it becomes
#: the old one, and the old one's entries go but for those met again, so rare pre-tokens never drive out frequent ones.
CACHE = 500_000
#: New pre-tokens in one text for the library.
JOINED = 200
FILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
#: The file format: row groups of 16 MB, pages of 256 kB or 4,000 rows, both with column and offset indexes (which
#: Spark's writer always adds); token ids by dictionary, the ascending columns as deltas.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "4000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
_EXOTIC = re.compile(r"[^\t\n\x0b\f\r -~À-ÖØ-öø-ÿ]")
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_PROBES = ("Ab cd's x'rex 12,3!? ÀÉ ñ.", "A\n\tB ''s $$$ a_b", "日本 é ſ ﬁ x  y ÄΣ ΑΣ", "it'S 'T' don't--%%%", "áb µ ²")


class TokenEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each pre-token and cache life.

    The tokenizer's normaliser and pre-tokenizer never look across ASCII blanks, and inside texts of ASCII and Latin-1
    letters they cut as _PLAIN does; probes check both against the library, which gets whole texts if one fails, as it
    does with texts that may hold special tokens.
    """

    def __init__(self, path: str, exact: bool | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.young, self.old, self.most = Tokenizer.from_file(path), ({}, {}), ({}, {}), cache
        starts = {x.content[:2] for x in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, starts))) if starts else None
        self.exact = True
        if exact is None:
            self.exact = all(np.array_equal(x, y) for x, y in zip(self.encode(list(_PROBES)), map(self._whole, _PROBES), strict=True))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, kind: int, lists: list[list[str]]) -> dict[str, bytes]:
        """The young generation's tokens of a kind, all those of the lists among them: one library call for many texts' new ones."""
        every = set().union(*lists)
        new = every.difference(self.young[kind])
        if sum(map(len, self.young)) + len(new) > self.most:
            self.old, self.young, new = self.young, ({}, {}), every
        known, old = self.young[kind], self.old[kind]
        met = new.intersection(old)
        known.update(zip(met, map(old.__getitem__, met), strict=True))
        new = list(new.difference(met))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            flat, sizes = self._joined(some) if kind == 0 else self._each(some)
            ends = [4 * n for n in itertools.accumulate(sizes, initial=0)]
            known.update(zip(some, map(flat.__getitem__, map(slice, ends, ends[1:])), strict=True))
        return known

    def _each(self, tokens: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all tokens and their number for each, every token a text of its own."""
        found = [e.ids for e in self.library.encode_batch_fast(tokens, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes(), list(map(len, found))

    def _joined(self, tokens: list[str]) -> tuple[bytes, list[int]]:
        """As _each for tokens that _PLAIN cut: the library gets JOINED of them as one text, blanks between, and says which
        ids belong to which; a text that it cuts into another number of pre-tokens is taken token by token."""
        lines = [tokens[at : at + JOINED] for at in range(0, len(tokens), JOINED)]
        ids, sizes = [], []
        for line, found in zip(lines, self.library.encode_batch(list(map(" ".join, lines)), add_special_tokens=False), strict=True):
            owners = found.word_ids
            counts = np.bincount(np.array(owners, np.int64)) if owners and None not in owners else np.zeros(0, np.int64)
            if len(counts) == len(line) and counts.all():
                ids.append(np.array(found.ids, "<u4").tobytes())
                sizes += counts.tolist()
            else:
                flat, some = self._each(line)
                ids.append(flat)
                sizes += some
        return b"".join(ids), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain, words = [], []
        for n, text in enumerate(texts):
            if not self.exact or self.special and self.special.search(text):
                out[n] = self._whole(text)
            else:
                (words if _EXOTIC.search(text) else plain).append(n)
        for kind, some, split in ((0, plain, lambda t: _PLAIN.findall(t.lower())), (1, words, _WORDS.findall)):
            lists = [split(texts[n]) for n in some]
            known = self._learn(kind, lists)
            for n, tokens in zip(some, lists, strict=True):
                out[n] = np.frombuffer(b"".join(map(known.__getitem__, tokens)), "<u4")
        return out


@cache
def _kept(path: str, most: int) -> TokenEncoder:
    return TokenEncoder(path, cache=most)


caches("token files", _kept.cache_clear)


def _encoder(path: str, most: int) -> TokenEncoder:
    """One encoder for a worker process, so that its cache outlives a task."""
    working("token files")
    return _kept(path, most)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, partitions: int | None = None, cache: int = CACHE) -> None:
    """Writes docs (doc_id, text) as token files in ascending doc_id order (null first, ties by text).

    Raw texts are range-partitioned and sorted first and encoded after that, so Spark's sampling pass costs a scan, not
    an encoding; a task streams its sorted rows and keeps no more than one Arrow batch.  A null text is empty and gets
    the end id alone; an empty table gives an empty data set.  Long texts are encoded whole.  `cache` bounds a worker's
    memory and has no influence on any id.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = _encoder(tokenizer, cache), TaskContext.get().partitionId(), 0
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                ids = encoder.encode(texts_of(piece))
                sizes = np.array([len(x) + len(tail) for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values = np.concatenate([y for x in ids for y in (x, tail)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(start + ends[:-1]), pa.array(sizes), lists], FILE.names)
                start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FILE).write.options(**LAYOUT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; reads the three narrow columns, not the ids.

    A document's start is its part's offset plus its start in the part; the offsets come from one row per part."""
    rows = spark.read.schema(FILE).parquet(path)
    return _started(rows.select("doc_id", "part", "start_in_part", "n_tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document; filters on doc_id reach the page indexes."""
    return _started(spark.read.schema(FILE).parquet(path))


def _started(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    order = sorted(totals)
    offsets = np.concatenate([[0], np.cumsum([totals[p] for p in order])]).tolist()
    parts = spark.createDataFrame([(p, int(o)) for p, o in zip(order, offsets, strict=False)], "at_part int, offset long")
    joined = rows.join(F.broadcast(parts), F.col("part") == F.col("at_part"))
    return joined.withColumn("start", F.col("offset") + F.col("start_in_part")).drop("at_part", "offset", "part", "start_in_part")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian 32-bit integers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("token digests")  # the encoder's cache ends before files are read back
        for batch in it:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
