"""What the trained scorers share: folds, the bounded labelled sample, and scoring beside the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows of each class, and characters of all their (whole) texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 40_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[int, str, int, str | None]]:
    """(doc_id, text, label, lang) of at most `rows` documents of each class outside the held-out fold, in the order of
    a hash of their ids, and at most `chars` characters in all: half for each class and what one leaves for both.  A text
    that does not fit is passed over, the shorter ones after it are not.

    Ids are chosen from labels alone; only their texts travel, by a join with those 2 * rows ids.  Rows without an id or
    with another label than 0 or 1 are not used, nor are ids that carry both labels; of documents that repeat an id the
    one with the least text, then language, is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), lang.alias("l"))
    found = texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min(F.struct("t", "l")).alias("x")).select("i", "x.t", "y", "x.l")
    sizes = {r["i"]: (r["y"], r["n"]) for r in found.select("i", "y", F.length("t").alias("n")).collect()}
    order = sorted(sizes, key=lambda i: (hash_of(i), i))
    kept, total = set(), 0
    for classes, most in (((0,), chars // 2), ((1,), chars - chars // 2), ((0, 1), chars)):  # at last what a class has left over
        used = total if len(classes) == 2 else 0
        for i in order:
            y, n = sizes[i]
            if i not in kept and y in classes and used + n <= most:
                kept.add(i)
                used, total = used + n, total + n
    got = {r["i"]: (r["i"], r["t"], r["y"], r["l"]) for r in (found if len(kept) == len(sizes) else found.where(F.col("i").isin(list(kept)))).select("i", "t", "y", "l").collect()}
    return [got[i] for i in sorted(got, key=lambda i: (hash_of(i), i))]


def hash_of(i: int) -> int:
    """A fixed mixing of ids, for orders that do not follow them."""
    x = (i ^ (i >> 31)) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    return x ^ (x >> 29)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], cut: float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, with the columns of `keep`; texts go through `score`
    a few hundred at a time and no row is shuffled."""

    def run(texts: pa.Array) -> pa.Array:
        out = [score([t or "" for t in texts.slice(at, 256).to_pylist()]) for at in range(0, len(texts), 256)]
        # six digits: sums in another batch may differ in the last ones
        return pa.array(np.round(np.concatenate(out), 6) if out else np.zeros(0), pa.float64())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(run, "double")(F.col(text)).alias("score"), *(keep or []))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *(keep or []))


def minibatches(n: int, size: int, epochs: int, seed: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, size):
            yield order[at : at + size]


class Adam:
    """Adam over named arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in arrays.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.arrays[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
