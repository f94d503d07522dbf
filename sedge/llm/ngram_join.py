"""Self-join of documents on word n-gram Jaccard similarity: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Scratch, packed_counts, shingle_hashes, summed_counts, texts_of, word_hashes
from sedge.llm.graph import components

#: Cells and groups beyond BLOCK rows (groups also beyond BLOCK_GRAMS n-grams) are dealt out in blocks of that size.
BLOCK, BLOCK_GRAMS = 1024, 4_000_000
#: Rounds in which the blocks of a large group are dealt anew and linked inside, before what is left apart is crossed.
ROUNDS = 2
_CLASS = "doc long, key binary, n_shingles long, task long, chunk int, counts binary"
_PREFIX = "doc long, key binary, size long, grams array<long>, sigs array<long>, loads array<int>"
_ROWS = ["gram", "size", "doc", "pos", "sig"]
_CELLS = "kind int, gram long, size long, doc long, pos long, sig long, a long, b long"
_EDGES = "a long, b long"


@dataclass(frozen=True)
class Rule:
    """Two documents link when den * |intersection| >= num * |union| of their sets of k-word shingles."""

    k: int = 3
    num: int = 90
    den: int = 100
    buckets: int = 1 << 24

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """Least intersection of sets of sizes a and b that link."""
        return -(-self.num * (a + b) // (self.num + self.den))


def _shingles(text: str, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes().of(text), k))


def _key(text: str) -> bytes | None:
    """128 bits of the word sequence; null without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _encoded(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes: exact below 32768, then 1024 steps for each doubling, rounded up; order is kept."""
    high = 32768 + np.ceil(1024 * np.log2(np.maximum(counts, 32768) / 32768))
    return np.where(counts < 32768, counts, np.minimum(high, 65535)).astype(np.uint16)


def _decoded(codes: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts."""
    c = codes.astype(np.int64)
    return np.where(c < 32768, c, np.minimum(np.ceil(32768 * 2.0 ** ((c - 32768) / 1024)), 2**31 - 1)).astype(np.int32)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).alias("text"))


def classes(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """For each document the 128-bit key of its word sequence (null without words) and its set's size; beside them, in
    rows without a document, each task's counts of shingles by bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(rule.buckets, np.uint32)
        schema = pa.schema([("doc", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("task", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in it:
            keys, sizes = [], []
            for t in texts_of(batch):
                s = _shingles(t, rule.k)
                np.add.at(counts, (s % np.uint64(rule.buckets)).astype(np.int64), 1)
                sizes.append(len(s))
                keys.append(_key(t))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *(pa.nulls(n, f.type) for f in list(schema)[3:])], schema=schema)
        for r in packed_counts(TaskContext.get().partitionId(), counts):
            yield pa.RecordBatch.from_pylist([r], schema)

    return _rows(docs, text).mapInArrow(run, _CLASS)


def prefixes(docs: DataFrame, rule: Rule, order, text: str = "text") -> DataFrame:
    """Each document's rarest shingles, rarest first by the broadcast counts (ties by hash), as many as a partner must
    share one of; with the sizes of four fixed hash regions of what follows each, for the suffix filter."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, buckets = order.value, np.uint64(rule.buckets)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for doc, t in zip(part.column("doc").to_pylist(), texts_of(part), strict=True):
                    s = _shingles(t, rule.k)
                    if not len(s) or doc is None:
                        continue
                    p = rule.prefix(len(s))
                    load = counts[(s % buckets).astype(np.int64)]
                    first = np.lexsort((s, load))[:p]
                    grams = s[first]
                    region = np.bincount((s >> np.uint64(62)).astype(np.int64), minlength=4)
                    after = region - np.cumsum(np.eye(4, dtype=np.int64)[(grams >> np.uint64(62)).astype(np.int64)], axis=0)
                    sigs = (np.minimum(after, 65535).astype(np.uint64) << np.array([0, 16, 32, 48], np.uint64)).sum(axis=1, dtype=np.uint64)
                    out.append((doc, _key(t), len(s), grams.view(np.int64), sigs.view(np.int64), _decoded(load[first])))
                if out:
                    d, k, n, g, z, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.binary()), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(t)) for x, t in ((g, pa.int64()), (z, pa.int64()), (c, pa.int32())))], ["doc", "key", "size", "grams", "sigs", "loads"])

    return _rows(docs, text).mapInArrow(run, _PREFIX)


def _passing(rule: Rule, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs of rows i, j can still reach the overlap: length, positional and suffix filter."""
    a, b, p, q = x["size"][i], x["size"][j], x["pos"][i], x["pos"][j]
    ok = (rule.den * np.minimum(a, b) >= rule.num * np.maximum(a, b)) & (x["doc"][i] != x["doc"][j])
    need = rule.overlap(a, b)
    ok &= np.minimum(a - p, b - q) >= need
    shift = np.array([0, 16, 32, 48], np.uint64)
    u, v = (((x["sig"][k].view(np.uint64)[:, None] >> shift) & np.uint64(65535)).astype(np.int64) for k in (i, j))
    return ok & (p + q + np.abs(u - v).sum(axis=1) <= a + b - 2 * need)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the graph of the edges a-b: (node, its component's smallest node), others left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[i] != root[j]).any():
        x, y = root[i], root[j]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _cell_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each cell, some hundred thousand at a time; small cells of one size go together."""
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
        i, j = np.triu_indices(m, 1)
        of_size = starts[sizes == m]
        step = max(1, 200_000 // len(i))
        for at in range(0, len(of_size), step):
            first = of_size[at : at + step, None]
            yield (first + i).ravel(), (first + j).ravel()
    for a, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        for at in range(a, a + m, 256):
            i, j = np.meshgrid(np.arange(at, min(at + 256, a + m)), np.arange(at + 1, a + m), indexing="ij")
            keep = i < j
            yield i[keep], j[keep]


def _candidates(rule: Rule, x: dict[str, np.ndarray], new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the pairs that pass the filters inside cells; `new` marks each cell's first row.  Pairs that the
    columns comp, side and within (if there) rule out are left out."""
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _cell_pairs(starts, sizes):
        if "comp" in x:
            ok = (x["comp"][i] != x["comp"][j]) & ((x["side"][i] != x["side"][j]) | x["within"][i].astype(bool))
            i, j = i[ok], j[ok]
        ok = _passing(rule, x, i, j)
        if ok.any():
            u, v = _forest(x["doc"][i[ok]], x["doc"][j[ok]])
            a.append(u)
            b.append(v)
    return _forest(np.concatenate(a), np.concatenate(b))


def _cells(it: Iterator[pa.RecordBatch], key: list[str], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool]]:
    """Sorted rows as (columns, first rows of cells, whether they are part of a cell too large for a block): many whole
    cells at a time, a larger cell in pieces of BLOCK rows, so that a task holds little however large a cell is."""
    held: dict[str, np.ndarray] | None = None
    large = None

    def parts(x: dict[str, np.ndarray], last: bool):
        nonlocal held, large
        n = len(x["doc"])
        new = np.ones(n, bool)
        new[1:] = np.any([x[c][1:] != x[c][:-1] for c in key], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        cut = n if last else int(starts[-1])  # the last cell may go on
        first = tuple(int(x[c][0]) for c in key)
        big = [k for k in range(len(starts)) if sizes[k] > BLOCK or (k == 0 and large == first)]
        whole = np.ones(n, bool)
        for k in big:
            whole[starts[k] : starts[k] + sizes[k]] = False
        whole[cut:] = False
        if whole.any():
            yield {c: v[whole] for c, v in x.items()}, new[whole], False
        keep = cut
        for k in big:
            end = starts[k] + sizes[k]
            for at in range(starts[k], end, BLOCK):
                if not last and end == n and at + BLOCK > end:
                    break  # the rest waits for more rows of its cell
                some = slice(at, min(at + BLOCK, end))
                first_row = np.zeros(some.stop - at, bool)
                first_row[0] = True
                large = tuple(int(x[c][at]) for c in key)
                yield {c: v[some] for c, v in x.items()}, first_row, True
                keep = max(keep, some.stop)
        held = None if keep >= n else {c: v[keep:] for c, v in x.items()}

    for batch in it:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in names}
        if len(x["doc"]):
            yield from parts(x, False)
    if held is not None:
        yield from parts(held, True)


def prefix_groups(prefix: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Kind 0: edges (a, b) that join documents with a pair that shares a prefix gram and passes the filters, a star for
    each component and so at most one edge a row, however many pairs there are.  Kind 1: the rows of grams too frequent
    for one cell, whose blocks have yet to meet each other.

    Grams whose count (an upper bound) exceeds `limit` are dealt to as many cells as that count makes blocks."""
    zipped = F.expr("transform(grams, (g, i) -> struct(g AS gram, CAST(i AS BIGINT) AS pos, sigs[i] AS sig, loads[i] AS load))")
    rows = prefix.select("doc", "size", F.explode(zipped).alias("z")).select("z.gram", "size", "doc", "z.pos", "z.sig", "z.load")
    cell = F.when(F.col("load") > limit, 1 + F.pmod(F.xxhash64("doc"), F.ceil(F.col("load") / BLOCK))).otherwise(0).cast("int")
    rows = rows.select(*_ROWS, cell.alias("cell")).repartition("gram", "cell").sortWithinPartitions("gram", "cell", "size", "doc")
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in (*_ROWS, "a", "b"))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, new, large in _cells(it, ["gram", "cell"], [*_ROWS, "cell"]):
            hot = (x["cell"] > 0) | large
            a, b = _candidates(rule, x, new)
            for kind, cols, n in ((0, {"a": a, "b": b}, len(a)), (1, {c: x[c][hot] for c in _ROWS}, int(hot.sum()))):
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(cols[c]) if c in cols else pa.nulls(n, pa.int64()) for c in (*_ROWS, "a", "b"))], schema=schema)

    return rows.mapInArrow(run, _CELLS)


def crossed(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows (key, comp, doc, ...) dealt to cells (k, p, q) in which every two rows of a key and of different components
    meet at least once; side and within say which pairs of a cell are meant: of two sides, or any.

    Only the rows outside a key's largest component are dealt to all blocks: they meet each other's blocks and those of
    the largest component, which never meet among themselves.  A key of one component has no cells.  `blocks` gives the
    number of blocks for the aggregates `rows` and `weight` (of sizes) of a part."""
    parts = rows.groupBy(key, "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    keys = parts.groupBy(key).agg(F.max(F.struct("n", "comp", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > top.n")
    few = blocks(F.col("n"), F.col("w"))
    keys = keys.select(F.col(key).alias("key2"), F.col("top.comp").alias("most"), few.alias("nt"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("na"), blocks(F.col("top.n"), F.col("top.w")).alias("nb"))
    dealt = rows.join(keys, F.col(key) == F.col("key2")).drop("key2")
    major = F.col("comp") == F.col("most")
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("doc"), F.when(major, F.col("nb")).otherwise(F.col("na"))).cast("int"))
    cell = lambda k, p, q, side, within: f"named_struct('k', {k}, 'p', CAST({p} AS INT), 'q', CAST({q} AS INT), 'side', {side}, 'within', {within})"
    cells = F.expr(
        f"CASE WHEN nt = 1 THEN array({cell(0, 0, 0, 0, 1)}) "
        f"WHEN comp = most THEN transform(sequence(0, CAST(na - 1 AS INT)), o -> {cell(2, 'o', 'blk', 1, 0)}) "
        f"ELSE concat(transform(sequence(0, CAST(na - 1 AS INT)), o -> {cell(1, 'least(blk, o)', 'greatest(blk, o)', 'IF(blk <= o, 0, 1)', 'IF(blk = o, 1, 0)')}), "
        f"transform(sequence(0, CAST(nb - 1 AS INT)), o -> {cell(2, 'blk', 'o', 0, 0)})) END"
    )
    return dealt.select(*rows.columns, F.explode(cells).alias("at")).select(*rows.columns, "at.*")


def hot_groups(hot: DataFrame, rule: Rule) -> DataFrame:
    """Edges, as in prefix_groups, between the components (comp) that the rows of frequent grams are in."""

    def run(cell: pa.Table) -> pa.Table:
        x = {c: cell.column(c).to_numpy() for c in ("size", "doc", "pos", "sig", "comp", "side", "within")}
        new = np.zeros(cell.num_rows, bool)
        new[0] = True
        a, b = _candidates(rule, x, new)
        return pa.table({"a": a, "b": b})

    return crossed(hot, "gram", lambda n, _: F.ceil(n / (BLOCK // 2))).groupBy("gram", "k", "p", "q").applyInArrow(run, _EDGES)


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the sets' intersections where `pairs` is true; by bit vectors over the grams that several sets hold,
    some columns at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if pairs.sum() <= 8:
        for i, j in zip(*np.nonzero(pairs), strict=True):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    step = max(64, (1 << 26) // n // 64 * 64)
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        here = (column >= at) & (column < at + step)
        width = -(-(int(column[here].max(initial=at)) - at + 1) // 64) * 64
        bits = np.zeros((n, width), bool)
        bits[owner[here], column[here] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in np.flatnonzero(pairs.any(axis=1)):
            j = np.flatnonzero(pairs[i])
            out[i, j] += np.bitwise_count(packed[i] & packed[j]).sum(axis=1, dtype=np.int64)
    return out


def _links(rule: Rule, cell: pa.Table) -> pa.Table:
    """Stars over the linked pairs of each group in a cell, compared on whole sets."""
    x = {c: cell.column(c).to_numpy() for c in ("sg", "doc", "comp", "side", "within")}
    grams = cell.column("grams").combine_chunks()
    flat, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
    order = np.argsort(x["sg"], kind="stable")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in np.split(order, np.flatnonzero(np.diff(x["sg"][order])) + 1):
        size = ends[at + 1] - ends[at]
        pairs = (x["comp"][at][:, None] != x["comp"][at]) & ((x["side"][at][:, None] != x["side"][at]) | (x["within"][at] == 1))
        pairs &= rule.den * np.minimum(size[:, None], size) >= rule.num * np.maximum(size[:, None], size)
        pairs = np.triu(pairs, 1)
        if pairs.any():
            common = _common([flat[ends[i] : ends[i + 1]] for i in at], pairs)
            i, j = np.nonzero(pairs & (rule.den * common >= rule.num * (size[:, None] + size - common)))
            u, v = _forest(x["doc"][at[i]], x["doc"][at[j]])
            a.append(u)
            b.append(v)
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def linked(sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what is linked in each group sg of sets (sg, doc, size, grams, blocks): every pair of a
    group is compared on whole sets or already joined by others, and at most one edge a row leaves a task.

    Groups within a block are bundled, some to a task.  A larger one is dealt to blocks, anew in each of ROUNDS rounds,
    and linked inside them; then its components are crossed, block by block, the largest with the others alone."""
    run = lambda cell: _links(rule, cell)
    total = sets.groupBy((F.col("blocks") > 1).alias("large")).agg(F.sum("size").alias("w")).collect()
    weight = {r["large"]: r["w"] for r in total}
    alone = [F.col("doc").alias("comp"), F.lit(0).alias("side"), F.lit(1).alias("within")]
    bundle = F.pmod(F.xxhash64("sg"), F.lit(1 + weight.get(False, 0) // (BLOCK_GRAMS // 4)))
    out = scratch.save(sets.where("blocks = 1").select("sg", "doc", "grams", *alone, bundle.alias("bundle")).groupBy("bundle").applyInArrow(run, _EDGES), "links")
    if True not in weight:
        return out
    large = sets.where("blocks > 1")
    for n in range(ROUNDS + 1):
        rows = large.withColumn("comp", F.col("doc"))
        if n:
            comps = components(out, scratch)
            rows = large.join(comps, F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "doc")).drop("node", "component")
        if n < ROUNDS:
            rows = rows.withColumn("k", F.pmod(F.xxhash64("doc", F.lit(n)), "blocks")).withColumns({"side": F.lit(0), "within": F.lit(1)})
            more = rows.groupBy("sg", "k").applyInArrow(run, _EDGES)
        else:
            blocks = lambda count, w: F.ceil(F.greatest(count / (BLOCK // 2), w / (BLOCK_GRAMS // 2)))
            more = crossed(rows, "sg", blocks).groupBy("sg", "k", "p", "q").applyInArrow(run, _EDGES)
        out = scratch.save(out.union(more), "links")
    return out


def _marks(members: DataFrame) -> np.ndarray:
    """A bit for each remainder of the members' ids, eight times as many as members, 2^25 at most."""
    size = 1 << min(25, max(16, int(members.count() * 8).bit_length()))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.zeros(size, np.uint8)
        for batch in it:
            bits[batch.column("doc").to_numpy(zero_copy_only=False) % size] = 1
        for r in packed_counts(TaskContext.get().partitionId(), bits):
            yield pa.RecordBatch.from_pylist([r], pa.schema([("task", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]))

    return summed_counts(members.select("doc").mapInArrow(mark, "task long, chunk int, counts binary"), size, lambda x: x > 0, bool)


def _sets(docs: DataFrame, members: DataFrame, rule: Rule, scratch: Scratch, text: str) -> DataFrame:
    """members (doc, key, ...) with the whole sets of their texts, once each, as a table.

    A broadcast bit table of bounded size names the members to the scan, so few other sets are built and no text moves."""
    marks = _marks(members)
    size, named = len(marks), docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = named.value
        for batch in it:
            at = batch.column("doc").to_numpy(zero_copy_only=False) % size
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            for n in range(0, batch.num_rows, 200):
                part = batch.slice(n, 200)
                texts = texts_of(part)
                keys, sets = [_key(t) for t in texts], [_shingles(t, rule.k).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["doc", "key", "grams"])

    found = _rows(docs, text).where("doc is not null").mapInArrow(run, "doc long, key binary, grams array<long>").where("key is not null")
    out = scratch.save(found.join(members, ["doc", "key"]).dropDuplicates(["doc", "key"]), "sets")
    named.destroy()
    return out


def join_documents(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    component_id is the smallest doc_id reachable by links, the row's own id if it has none.  Texts with the same words
    are one class and take part once, by their smallest id.  A class's prefix grams bring it together with its possible
    partners, cell by cell; pairs that pass the length, positional and suffix filters make groups (a star of edges for
    each, never the pairs themselves).  Every pair that can link lies in one group, so whole sets are compared once,
    inside the groups.  Sets are sets of 64-bit hashes of shingles.

    Null or empty text, or one without words: size 0, linked with nothing.  Fewer words than k: the sequence is the one
    shingle.  Null doc_id: component null, links with nothing.  Rows that repeat an id count as one document, linked
    with whatever one of its texts is.  No rows: no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    both = scratch.save(classes(docs, rule, text), "classes")
    order = spark.sparkContext.broadcast(summed_counts(both.where("chunk is not null").select("task", "chunk", "counts"), rule.buckets, _encoded, np.uint16))
    rows = scratch.save(both.where("chunk is null").select("doc", "key", "n_shingles"), "rows")
    limit = max(BLOCK, 4 * (rows.agg(F.sum("n_shingles")).first()[0] or 0) // rule.buckets)
    scratch.drop(both)
    scratch.tidy()
    named = rows.where("doc is not null")
    reps = scratch.save(named.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"), F.first("n_shingles").alias("size")), "reps")
    prefix = prefixes(docs, rule, order, text).join(reps.select("doc", "key"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    first = scratch.save(prefix_groups(prefix, rule, limit), "groups")
    order.destroy()
    scratch.tidy()
    edges, hot = first.where("kind = 0").select("a", "b"), first.where("kind = 1").select(*_ROWS)
    groups = components(edges, scratch)
    if not hot.isEmpty():
        placed = hot.join(groups, F.col("doc") == F.col("node"), "left").select(*_ROWS, F.coalesce("component", "doc").alias("comp"))
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(hot_groups(placed, rule)), scratch)
    members = scratch.save(reps.join(groups, F.col("doc") == F.col("node")).select("doc", "key", F.col("component").alias("sg"), "size"), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)).alias("blocks")
    members = members.join(members.groupBy("sg").agg(blocks), "sg")
    links = linked(_sets(docs, members, rule, scratch, text), rule, scratch)
    # an id with several texts is one document: it joins its texts' classes
    several = named.groupBy("doc").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.count("key").alias("nk")).where("lo != hi or nk < n").select("doc")
    own = named.join(several, "doc").select(F.col("doc").alias("a"), "key").join(reps.select("key", F.col("doc").alias("b")), "key").select("a", "b")
    comps = scratch.save(components(links.union(own), scratch), "components")
    scratch.tidy()
    of_class = reps.join(comps, F.col("doc") == F.col("node"), "left").select("key", F.coalesce("component", "doc").alias("component_id"))
    worded = rows.where("key is not null").join(of_class, "key", "left")
    empty = rows.where("key is null").join(comps, F.col("doc") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc"))
    out = worded.select("doc", "n_shingles", "component_id").union(empty.select("doc", "n_shingles", "component_id"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id, all columns as they are.

    Rows without an id or without words stay; rows that repeat a kept id with the same text stay as they are."""
    mark = "__sedge_gone"
    gone = join_documents(docs, rule, text).where("component_id < doc_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[mark], "left_anti")


#: join_documents with its default rule in DuckDB, by all pairs that share a shingle.
JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda x: array_to_string(w[x:x + 2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
