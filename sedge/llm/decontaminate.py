"""Benchmark decontamination: MinHash containment search for short items inside whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Scratch, WordHashes, shingle_hashes, word_hashes

#: Items that one broadcast index holds; more items are searched for in further blocks, each with a pass of its own.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16 << 20
MATCHES = "array<struct<item_id: bigint, n_shared: bigint, n_shingles: bigint>>"


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Index:
    """MinHash sketches of one block of items, partitioned by size.

    A partition holds the items of one shingle length and one power-of-two range of set sizes.  An item of n shingles is
    contained at threshold t if at most n - ceil(t n) of them are missing.  Its sketch is the m shingles with the least
    hashes, m = 2 (n - ceil(t n)) + 1 or n if that is less; of these a containing document, however long, has at least
    m - (n - ceil(t n)), because no more can be missing.  So looking sketches up loses nothing; hashes only choose which
    shingles are looked up.
    """

    items: list[tuple[int, list[bytes]]]
    k: int
    threshold: tuple[int, int]
    partitions: dict[tuple[int, int], dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        hashes = WordHashes()
        groups: dict = {}
        for item, words in self.items:
            if words:
                k = min(self.k, len(words))
                w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                s = np.unique(shingle_hashes(w, k))
                groups.setdefault((k, int(len(s)).bit_length()), []).append((item, words, s))
        num, den = self.threshold
        for at, rows in groups.items():
            sketch, owner, needs = [], [], []
            for n, (_, _, s) in enumerate(rows):
                may_miss = len(s) - -(-num * len(s) // den)
                m = min(len(s), 2 * may_miss + 1)
                sketch.append(s[:m])
                owner.append(np.full(m, n))
                needs.append(m - may_miss)
            flat, own = np.concatenate(sketch), np.concatenate(owner)
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(flat & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.partitions[at] = {"rows": rows, "sketch": flat[order], "owner": own[order], "needs": np.array(needs), "bits": bits}

    def matches(self, words: list[bytes], hashes: np.ndarray) -> list[dict]:
        """Items whose share of shingles in the document reaches the threshold, counted on the words themselves."""
        out, of_k = [], {}
        num, den = self.threshold
        for (k, _), p in self.partitions.items():
            if len(words) < k:
                continue
            s = of_k[k] if k in of_k else of_k.setdefault(k, shingle_hashes(hashes, k))
            hit = np.unique(s[p["bits"][(s & np.uint64(0xFFFFF)).astype(np.int64)]])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(p["sketch"], hit, "left"), np.searchsorted(p["sketch"], hit, "right")
            found = np.concatenate([p["owner"][a:b] for a, b in zip(lo, hi, strict=True) if b > a] or [np.array([], np.int64)])
            counts = np.bincount(found, minlength=len(p["needs"]))
            for n in np.flatnonzero(counts >= p["needs"]):
                item, item_words, item_hashes = p["rows"][n]
                here = {tuple(words[i : i + k]) for i in np.flatnonzero(np.isin(s, item_hashes))}
                own = {tuple(item_words[i : i + k]) for i in range(len(item_words) - k + 1)}
                shared = len(here & own)
                if den * shared >= num * len(own):
                    out.append({"item_id": item, "n_shared": shared, "n_shingles": len(own)})
        return sorted(out, key=lambda r: r["item_id"])


def _blocks(items: DataFrame, text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items, a bounded block at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col(text).alias("t")).where("i is not null").toLocalIterator():
        words = _words(r["t"] or "")
        held.append((r["i"], words))
        size += len(r["t"] or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searches(docs: DataFrame, items: DataFrame, k: int, threshold: tuple[int, int], text: str) -> Iterator[tuple[Column, bool]]:
    """For each block of items in turn: a column of its matches in docs' texts, and whether it is the last block.

    But for the last one, the caller writes its result down before it asks for the next: the block's index is destroyed
    then, so neither the driver nor a worker ever holds two, however many items there are.
    """
    spark = docs.sparkSession
    blocks = _blocks(items, text)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        index = spark.sparkContext.broadcast(Index(block, k, threshold))
        yield F.arrow_udf(_finder(index), MATCHES)(F.col(text)), after is None
        if after is not None:
            index.destroy()
        block = after


def with_matches(docs: DataFrame, items: DataFrame, column: str = "matches", k: int = 5, threshold: tuple[int, int] = (80, 100), text: str = "text") -> DataFrame:
    """docs with an array of (item_id, n_shared, n_shingles) for the items found in each whole text.

    An item is found if the document has at least `threshold` of its distinct k-word shingles (A-Z lower-cased, words
    between ASCII blanks); an item of fewer than k words is one shingle.  Nothing is shuffled: the sketches of a block of
    items are broadcast (at most BLOCK_ITEMS items or about BLOCK_BYTES of text); each further block reads the texts
    again, from a table written after the block before.  Null or empty texts match nothing, nor do null, empty or
    wordless items and those without an id; items that repeat are reported each; repeated rows of docs get the same
    matches.  Without items or documents the result is empty arrays or no rows.
    """
    scratch, before = Scratch(docs.sparkSession), None
    out = docs.withColumn(column, F.array().cast(MATCHES))
    for found, last in _searches(docs, items, k, threshold, text):
        out = out.withColumn(column, F.concat(column, found))
        if not last:
            out = scratch.save(out, "matches")
            if before is not None:
                scratch.drop(before)
            before = out
    return out


def _finder(index):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())]))

    def find(texts: pa.Array) -> pa.Array:
        hashes, out = word_hashes(), []
        for t in texts.to_pylist():
            words = _words(t or "")
            out.append(index.value.matches(words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
        return pa.array(out, kind)

    return find


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles), one row for each item found in a document; rules as for with_matches.
    With several blocks of items only the rows found are written down between them."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for found, last in _searches(rows, items, k, threshold, "text"):
        part = rows.withColumn("m", found).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
        part = part if last else scratch.save(part, "found")
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.select("doc_id", F.explode(F.array().cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), text: str = "text") -> DataFrame:
    """docs without those in which an item is found; other rows and all columns as they are; rules as for with_matches."""
    scratch, mark, before = Scratch(docs.sparkSession), "__sedge_matches", None
    out = docs
    for found, last in _searches(docs, items, k, threshold, text):
        out = out.withColumn(mark, found).where(F.size(mark) == 0).drop(mark)
        if not last:
            out = scratch.save(out, "clean")
            if before is not None:
                scratch.drop(before)
            before = out
    return out


#: The same in DuckDB, for items of five words or more.
FIND_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM s GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))) AS s FROM d)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_shingles FROM u JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""
