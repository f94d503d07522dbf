"""Token counts with a two-tier lookup beside the scan: no pre-token is ever shuffled."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import caches, texts_of, working

#: Entries of the broadcast table, and of each task's summary of frequent pre-tokens.
TABLE, SUMMARY = 32_768, 8_192
#: Entries of a worker's own cache; when full it starts anew.
CACHE = 500_000
_SUMMARIES = "part long, words array<string>, counts array<long>"


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _splitter(path: str) -> re.Pattern:
    """Where a text may be cut without changing its pieces.

    BPE joins two symbols only if the joined string is a piece, so between two characters that no piece of the
    vocabulary holds side by side nothing can ever be joined.  From the vocabulary's own neighbour pairs we check the
    three kinds of cut the pattern makes: before blanks, after letters, and between letters and anything else than a
    preceding blank (a newline is a byte piece, which nothing joins).  Should a vocabulary lack one of them, the pattern
    falls back to wider pre-tokens.
    """
    sp = _model(path)
    letter = re.compile(r"[^\W\d_]")
    before_blank = letter_other = newline = False
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        newline |= "\n" in piece
        for a, b in zip(piece, piece[1:], strict=False):
            before_blank |= b == "▁" != a
            letter_other |= b != "▁" and bool(letter.match(a)) and not letter.match(b)
    if before_blank or newline:
        return re.compile(r"(?s).+")
    if letter_other:
        return re.compile(r" *[^ ]+| +")
    return re.compile(r" *(?:[^\w \n]|[\d_])*[^\W\d_]+| *(?:[^\w \n]|[\d_])+|\n| +")


#: Probes for what the vocabulary alone does not say: that the normaliser keeps texts as they are but for one blank in front.
_PROBES = ("a", " a", "a  b ", "Ab\n\ncd, e.", "ſ ﬁ ² x\u00a0y \u3000z", "\t q\r\n", "1,234.50 e\u0301é <s> </s>", "日本 語 🎉 \u200b.")


@cache
def _exact(path: str) -> bool:
    """Whether summing pre-token lengths gives the library's counts on the probes; else whole texts go to the library."""
    counter = PieceCounter(path, exact=True)
    return all(counter.count(x) == len(_model(path).encode(x)) for x in _PROBES)


class PieceCounter:
    """Number of pieces of a text: pre-token lengths from the shared table, then the worker's cache, then the library."""

    def __init__(self, path: str, shared: dict[str, int] | None = None, exact: bool | None = None):
        self.path, self.shared, self.own = path, shared or {}, {}
        self.split, self.exact = _splitter(path), _exact(path) if exact is None else exact

    def learn(self, words: list[str]) -> None:
        """The library knows no text without its dummy blank in front, so a pre-token is measured behind a newline,
        which is one byte piece that joins nothing, and the two known pieces are taken off."""
        if len(self.own) + len(words) > CACHE:
            self.own.clear()
        for w, ids in zip(words, _model(self.path).encode(["\n" + w for w in words], num_threads=1), strict=True):
            self.own[w] = len(ids) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact or "▁" in text or "\x00" in text:
            return len(_model(self.path).encode(text, num_threads=1))
        words = self.split.findall(" " + text)
        shared, own = self.shared, self.own
        lengths = [shared.get(w) or own.get(w) for w in words]
        if None in lengths:
            self.learn(list({w for w, n in zip(words, lengths, strict=True) if n is None}))
            lengths = [own.get(w, 0) if n is None else n for w, n in zip(words, lengths, strict=True)]
        return sum(lengths)


def _trimmed(counts: Counter, most: int) -> Counter:
    """Misra-Gries: subtract the count below the cut, so a summary stays mergeable and its error bounded."""
    if len(counts) <= most:
        return counts
    top = counts.most_common(most + 1)
    cut = top[most][1]
    return Counter({w: n - cut for w, n in top[:most] if n > cut})


def frequent(docs: DataFrame, path: str, text: str = "text", table: int = TABLE) -> dict[str, int]:
    """Lengths of the pre-tokens that all tasks' summaries hold most often; at most `table` entries.

    Every text is read whole.  Each task keeps one bounded summary; summaries (not pre-tokens) are merged in a tree of
    fan-in 64, so neither a task nor the driver gets more than 64 summaries at once.  The choice of entries has no
    influence on any count, only on how often a worker has to ask the library.
    """

    def summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, counts = _splitter(path), Counter()
        for batch in it:
            for t in texts_of(batch):
                counts.update(split.findall(" " + t))
                if len(counts) > 40 * SUMMARY:
                    counts = _trimmed(counts, SUMMARY)
        counts = _trimmed(counts, SUMMARY)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "words": [list(counts)], "counts": [list(counts.values())]}, _schema())

    def merged(group: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for words, n in zip(group.column("words").to_pylist(), group.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(words, n, strict=True)))
        counts = _trimmed(counts, max(SUMMARY, table))
        return pa.table({"part": [group.column("up")[0].as_py()], "words": [list(counts)], "counts": [list(counts.values())]}, schema=_schema())

    rows = docs.select(F.col(text).alias("text")).mapInArrow(summaries, _SUMMARIES)
    tasks = max(1, docs.select(text).rdd.getNumPartitions())
    while tasks > 1:
        rows = rows.withColumn("up", F.floor(F.col("part") / 64)).groupBy("up").applyInArrow(merged, _SUMMARIES)
        tasks = -(-tasks // 64)
    counts: Counter = Counter()
    for r in rows.collect():
        counts.update(dict(zip(r["words"], r["counts"], strict=True)))
    words = [w for w, n in counts.most_common(table)]
    counter = PieceCounter(path)
    counter.learn(words)
    return {w: counter.own[w] for w in words if counter.own[w] > 0}


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096, table: int = TABLE) -> DataFrame:
    """docs' doc_id with n_bytes, n_tokens and over_limit for every whole text; one row for each input row.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each; a null doc_id stays null.  Texts of
    any length are handled in pre-tokens.  The broadcast table has at most `table` short strings.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(frequent(docs, path, text, table)), uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, key, shared.value)
        for batch in it:
            column = batch.column("text")
            n = pa.array([counter.count(t) for t in texts_of(batch)], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_held: dict = {}
caches("token counts", _held.clear)


def _counter(path: str, key: str, shared: dict[str, int]) -> PieceCounter:
    """One counter for a worker process and broadcast, so that its cache outlives a task."""
    working("token counts")
    at = (path, key)
    if at not in _held:
        _held.clear()
        _held[at] = PieceCounter(path, shared)
    return _held[at]
