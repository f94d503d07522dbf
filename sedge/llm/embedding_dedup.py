"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Scratch
from sedge.llm.graph import components

#: In a pass, two vectors of one label meet if their ranks differ by at most WINDOW.  MISS is the share of pairs at the
#: threshold that all passes together may miss in the largest label if its vectors are spread out; it sets their number.
WINDOW, MISS, SEED = 1024, 0.001, 20_240_501
#: Numbers in the vectors of one task's block, which is at least two windows long.
BLOCK_NUMBERS = 1 << 22


def passes_for(size: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes for a label of `size` vectors: one where a window holds it whole; else log2(size / window) one-bit hashes
    bring a vector's neighbours down to a window, two vectors at the threshold's angle t agree in each with probability
    1 - t / pi, and passes are independent."""
    if size <= window + 1:
        return 1
    met = (1 - np.arccos(threshold) / np.pi) ** np.log2(size / window)
    return int(np.ceil(np.log(miss) / np.log1p(-met)))


@cache
def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    """Normals of 63 random hyperplanes for each pass."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * 63))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, scaled first so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(rows: DataFrame) -> DataFrame:
    """The vectors that can link, as they are, with a row number and their dimension."""
    wrong = "x is null or isnan(x) or abs(x) = double('infinity')"
    rows = rows.where(f"vec_id is not null and label is not null and v is not null and not exists(v, x -> {wrong}) and exists(v, x -> x != 0)")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("v").alias("dim"), "v")


def _keyed(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """A key for each vector and pass: 63 one-bit hashes, the first the most significant."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
        for batch in it:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cells = batch.column("v")
            flat, ends = cells.values.to_numpy(zero_copy_only=False), cells.offsets.to_numpy()
            for dim in np.unique(dims):
                every = np.flatnonzero(dims == dim)
                for n in range(0, len(every), 1000):
                    at = every[n : n + 1000]
                    bits = _unit(flat[ends[at][:, None] + np.arange(dim)]) @ _planes(int(dim), passes, seed) > 0
                    keys = bits.reshape(len(at), passes, 63) @ weight
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * passes, pa.int32()), pa.array(keys.ravel()))
                    part = batch.select(["row", "vec_id", "label", "dim"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], ["row", "vec_id", "label", "dim", "keys"])

    return vectors.select("row", "vec_id", "label", "dim", "v").mapInArrow(run, "row long, vec_id long, label string, dim int, keys array<long>")


def _ranks(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """row, pass and rank of each vector in one global order by pass, label, dimension, key; ties by id and row."""
    spark = keyed.sparkSession
    flat = keyed.select("row", "vec_id", "label", "dim", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "label", "dim", "key", "vec_id", "row"]

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in it:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("pass"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], ["row", "pass", "part", "n"])
            at += n

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = scratch.save(flat.repartitionByRange(n, *order).sortWithinPartitions(*order).select("row", "pass").mapInArrow(number, "row long, pass int, part int, n long"), "ranks")
    sizes = {r["part"]: r["count"] for r in local.groupBy("part").count().collect()}
    parts = sorted(sizes)
    offsets = itertools.accumulate((sizes[p] for p in parts), initial=0)
    starts = spark.createDataFrame(list(zip(parts, offsets, strict=False)), "at int, start long")
    return local.join(F.broadcast(starts), F.col("part") == F.col("at")).select("row", "pass", (F.col("n") + F.col("start")).alias("rank"))


def _joined(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """comp, each row's least known group member, after the links i-j."""
    while True:
        a, b = comp[i], comp[j]
        if not (a != b).any():
            return comp
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while (comp != comp[comp]).any():
            comp = comp[comp]


def _copies(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of equal label and vector as one: (vec_id, c rows, rep), and by rep vec_id the least id, m rows and own.

    Rows whose id other rows have too stay apart from the other ids' (own is their id, else null), as they do not link
    with each other.  Groups are pre-aggregated and joined on 128 bits of the vector, so a hot vector is no large task.
    """
    at = keyed.select("vec_id", "row", F.xxhash64("label", "dim", "v").alias("h1"), F.xxhash64(F.lit(2), "label", "dim", "v").alias("h2"))
    at = at.groupBy("vec_id", "h1", "h2").agg(F.count("*").alias("c"), F.min("row").alias("row"))
    often = at.groupBy("vec_id").agg(F.sum("c").alias("t")).where("t > 1").select("vec_id", F.col("vec_id").alias("own"))
    at = scratch.save(at.join(often, "vec_id", "left"), "members")
    reps = scratch.save(at.groupBy("own", "h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.sum("c").alias("m"), F.min("row").alias("rep")), "reps")
    by = reps.select(F.col("own").alias("own2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep")
    members = at.join(by, at["own"].eqNullSafe(by["own2"]) & (at["h1"] == by["g1"]) & (at["h2"] == by["g2"])).select("vec_id", "c", "rep")
    return members, reps.select("rep", "vec_id", "m", "own")


def _counted(reps: DataFrame, comps: DataFrame, threshold: float, block: int, scratch: Scratch) -> DataFrame:
    """(rep, n): the rows each rep's rows link with, exactly within its component; reps without any may be missing.

    A component's vectors of one label are dealt to blocks of about `block` by a hash; a task gets two blocks, however
    large the component, or as many small components as make up about a block.
    """
    group = ["component", "label", "dim"]
    mine = scratch.save(reps.join(comps, reps["vec_id"] == comps["node"]).drop("node"), "grouped")
    sizes = mine.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    tasks = max(1, mine.count() // block)
    dealt = mine.join(sizes.select(*[F.col(x).alias(f"{x}2") for x in group], "size"), F.expr(" AND ".join(f"{x} = {x}2" for x in group)))
    dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*group), F.lit(tasks))).otherwise(F.xxhash64(*group))
    dealt = dealt.select("rep", "vec_id", "m", "own", *group, "v", "b", bundle.alias("bundle"), F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def count(rows: pa.Table) -> pa.Table:
        kinds = list(zip(*(rows.column(x).to_pylist() for x in group), strict=True))
        number = {k: n for n, k in enumerate(dict.fromkeys(kinds))}
        kind = np.array([number[k] for k in kinds])
        order = np.argsort(kind, kind="stable")
        b, ids, m = (rows.column(x).to_numpy() for x in ("b", "vec_id", "m"))
        apart = ~rows.column("own").is_null().to_numpy()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        cells = rows.column("v").combine_chunks()
        flat, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
        total = np.zeros(len(ids), np.int64)
        for at in np.split(order, np.cumsum(np.bincount(kind))[:-1]):
            x = _unit(flat[ends[at][:, None] + np.arange(ends[at[0] + 1] - ends[at[0]])])
            for k in range(0, len(at), 128):
                i, j = np.nonzero(x[k : k + 128] @ x.T >= threshold)
                i, j = at[i + k], at[j]
                # two blocks: pairs within one of them are another task's; ids that repeat do not link with themselves
                ok = (i != j) & ~(apart[i] & (ids[i] == ids[j])) & ((lo == hi) | (b[i] != b[j]))
                np.add.at(total, i[ok], m[j[ok]])
        return pa.table({"rep": rows.column("rep"), "n": total})

    found = dealt.groupBy("bundle", "lo", "hi").applyInArrow(count, "rep long, n long")
    return found.groupBy("rep").agg(F.sum("n").alias("n"))


def link_vectors(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, window: int = WINDOW, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    Each pass orders all vectors by label and concatenated random-hyperplane bits and compares each with the `window`
    vectors after it: ranks are cut into blocks of some windows (BLOCK_NUMBERS), and a task gets one block and the first
    window of the next, however hot a label.  Equal vectors of one label are one there, with a multiplicity.  Vectors
    travel as they are stored; cosines are taken in double precision, links are pairs at `threshold` or above.  A task
    hands on one edge for each linked row, and components are joined over those edges.  n_links is counted after that,
    exactly within each component, by pairs of blocks of `window`, so it does not end at a window however large a group
    of near copies; that costs the square of such a group's distinct vectors in comparisons.

    Labels with at most window + 1 vectors are compared completely.  The number of passes grows with the largest label
    (passes_for) unless given; a pair is missed if no pass brings it within a window and no chain of other links joins
    its ends.  Tests and README measure the recall against brute force.

    A null, zero or empty vector, one with null or non-finite components, a null label or a null id links with nothing:
    n_links 0, component_id its own id (null for a null id), kept true (null for a null id).  Finite components of any
    size are compared.  Vectors of different dimensions never link.  Rows that repeat an id are compared with other ids
    only; their links are added up.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = vectors.schema[embedding].dataType.simpleString()
    v = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.col(label).cast("string").alias("label"))
    usable = scratch.save(_usable(rows), "usable")
    members, reps = _copies(usable, scratch)
    reps = scratch.save(reps.join(usable.drop("vec_id"), reps["rep"] == usable["row"]), "vectors")
    scratch.drop(usable)
    most = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n"), F.max("dim")).first()
    if passes is None:
        passes = passes_for(most[0] or 0, threshold, window)
    span = window * max(2, min(8, BLOCK_NUMBERS // (window * (most[1] or 1))))
    ranks = _ranks(scratch.save(_keyed(reps, passes, seed), "keys"), scratch)
    ranks = ranks.groupBy("row").agg(F.collect_list(F.struct("pass", "rank")).alias("ranks"))
    # a block's rows, and behind them the first window of the next block
    cells = F.expr(f"flatten(transform(ranks, r -> filter(array(struct(r.pass, r.rank, r.rank div {span}L AS block, 0 AS side), struct(r.pass, r.rank, r.rank div {span}L - 1 AS block, 1 AS side)), c -> c.side = 0 OR r.rank % {span}L < {window}L)))")

    def block(group: pa.Table) -> pa.Table:
        rank, side, ids, dims = (group.column(c).to_numpy() for c in ("rank", "side", "vec_id", "dim"))
        kinds = list(zip(group.column("label").to_pylist(), dims, strict=True))
        number = {k: n for n, k in enumerate(dict.fromkeys(kinds))}
        kind = np.array([number[k] for k in kinds])
        order = np.lexsort((rank, kind))
        cells = group.column("v").combine_chunks()
        flat, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
        comp = np.arange(len(ids))
        for at in np.split(order, np.cumsum(np.bincount(kind))[:-1]):
            left, columns = int((side[at] == 0).sum()), np.arange(dims[at[0]])
            for k in range(0, left, 256):
                here = at[k : k + 256 + window]
                x = _unit(flat[ends[here][:, None] + columns])
                i, j = np.nonzero(x[: min(256, left - k)] @ x.T >= threshold)
                i, j = here[i], here[j]
                ok = (rank[j] > rank[i]) & (rank[j] - rank[i] <= window) & (ids[i] != ids[j])
                if ok.any():
                    comp = _joined(comp, i[ok], j[ok])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, ids)
        root = least[comp]
        out = root != ids
        return pa.table({"vec_id": ids[out], "root": root[out]})

    ready = reps.select("row", "vec_id", "label", "dim", "v").join(ranks, "row").withColumn("c", F.explode(cells))
    seen = ready.select("vec_id", "label", "dim", "v", "c.*").groupBy("pass", "block").applyInArrow(block, "vec_id long, root long")
    comps = scratch.save(components(seen.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch), "components")
    linked = scratch.save(_counted(reps, comps, threshold, window, scratch), "links")
    # a rep's rows under ids of their own also link with each other
    known = reps.select("rep", F.col("vec_id").alias("least"), F.when(F.col("own").isNull(), F.col("m") - 1).otherwise(0).alias("same"))
    known = known.join(linked, "rep", "left").join(comps, F.col("least") == F.col("node"), "left")
    known = known.select("rep", (F.col("same") + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component"))
    found = members.join(known, "rep").groupBy(F.col("vec_id").alias("id")).agg(F.sum(F.col("c") * F.col("n")).alias("n"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(found, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same in DuckDB, by all pairs of a label.
LINK_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
r AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN r USING (vec_id) LEFT JOIN n USING (vec_id)
"""
