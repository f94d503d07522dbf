"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import WORD, Scratch

#: A table of rates with at most this many sources and bytes of names is broadcast; larger ones stay distributed.
MOST_SOURCES, MOST_BYTES = 200_000, 32 << 20
#: Sources of at least this share of all rows, so at most 1 / HOT of them, are broadcast even then.
HOT = 1e-5
PATTERN = (3, 1, 2)
RATES = "mix_source string, mix_source_size long, mix_target double, mix_rate double"


def cycle_weights(names: list[str | None], weights: tuple[int, ...] = PATTERN) -> dict[str | None, int]:
    """Sources in code-point order, null last, weigh 3, 1, 2, 3, 1, 2, ..."""
    order = sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in names)
    return {n: weights[i % len(weights)] for i, n in enumerate(order)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, int], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: share * total by weight, none above most * its size, the excess reshared by weight."""
    budget, capped = share * sum(sizes.values()), {n for n in sizes if sizes[n] == 0}
    while True:
        rest = [n for n in sizes if n not in capped]
        left, w = budget - sum(most * sizes[n] for n in capped), sum(weights[n] for n in rest)
        over = [n for n in rest if weights[n] * left > most * sizes[n] * w]
        if not over:
            return {n: most * sizes[n] if n in capped else weights[n] * left / w for n in sizes}
        capped.update(over)


def copies(rate, seed: str, *key):
    """Column: floor(rate) plus one more with probability rate - floor(rate), decided by an MD5 of seed and key."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *key)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _small_rates(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """mix_source, mix_source_size, mix_target and mix_rate of a few sources, worked out on the driver."""
    sizes = {r["source"]: r["size"] for r in totals.collect()}
    wanted = targets(sizes, cycle_weights(list(sizes), weights), share, most) if sizes else {}
    rows = [(n, sizes[n], float(wanted[n]), wanted[n] / sizes[n] if sizes[n] else 0.0) for n in sizes]
    return totals.sparkSession.createDataFrame(rows, RATES)


def _large_rates(totals: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """The same for any number of sources: they are sorted over the cluster, their places follow from one count a
    partition, and the level of the targets rises by one sum over the sources at a time until no source is above it."""
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    local = scratch.save(totals.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["count"]) for r in local.groupBy(part.alias("p")).count().collect())
    starts = spark.createDataFrame(list(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0), strict=False)), "p long, start long")
    rank = (F.col("start") + place) % len(weights) + 1
    weighed = local.join(F.broadcast(starts), part == F.col("p")).select("source", "size", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int")).cast("double").alias("w"))
    weighed = scratch.save(weighed, "weights")
    budget, level = share * (weighed.agg(F.sum("size")).first()[0] or 0), 0.0  # a source takes level * weight or its cap
    free = F.lit(most) * F.col("size") >= F.lit(level) * F.col("w")
    while True:
        r = weighed.agg(F.sum(F.when(~free, F.lit(most) * F.col("size"))).alias("capped"), F.sum(F.when(free & (F.col("size") > 0), F.col("w"))).alias("w")).first()
        now = (budget - (r["capped"] or 0.0)) / r["w"] if r["w"] else level
        if now <= level:
            break
        level = now
        free = F.lit(most) * F.col("size") >= F.lit(level) * F.col("w")
    target = F.least(F.lit(most) * F.col("size"), F.lit(level) * F.col("w"))
    return weighed.select(F.col("source").alias("mix_source"), F.col("size").alias("mix_source_size"), target.alias("mix_target"), F.when(F.col("size") > 0, target / F.col("size")).otherwise(0.0).alias("mix_rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = PATTERN, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target (the source's), rate and n_copies added under the prefix `mix_`.

    A document's size is its number of words (null: 0).  Two jobs: totals by source (pre-aggregated), then a map over the
    documents with the rates broadcast; no document is shuffled, so a hot source costs nothing.  With more than
    MOST_SOURCES sources, or MOST_BYTES of their names, rates stay a table; then only sources that hold a share of HOT of
    all rows are broadcast, and the other documents are joined by source, of which none is hot.  A source's expected
    words equal its target; one document's copies depend on seed and doc_id alone, so reruns and retried tasks agree.
    Repeated rows get equal draws.  An empty table stays empty; sources of size 0 get target and rate 0; a null source is
    a source of its own; a null doc_id draws as ''.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    totals = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    totals = scratch.save(totals, "totals")
    all_of = totals.agg(F.count("*").alias("k"), F.sum(F.octet_length("source")).alias("b"), F.sum("n").alias("n")).first()
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    sized = docs.withColumn("mix_size", size)
    if all_of["k"] <= MOST_SOURCES and (all_of["b"] or 0) <= MOST_BYTES:
        out = sized.join(F.broadcast(_small_rates(totals, weights, share, most)), same, "left").drop("mix_source")
    else:
        rates = scratch.save(_large_rates(totals.select("source", "size"), scratch, weights, share, most), "rates")
        hot_names = totals.where(F.col("n") >= F.lit(HOT * all_of["n"])).select(F.col("source").alias("hot_source"))
        hot = rates.join(F.broadcast(hot_names), F.col("mix_source").eqNullSafe(F.col("hot_source")), "left_semi")
        cold = rates.join(F.broadcast(hot_names), F.col("mix_source").eqNullSafe(F.col("hot_source")), "left_anti")
        out = sized.join(F.broadcast(hot), same).drop("mix_source").union(sized.join(cold.hint("merge"), same).drop("mix_source"))
    return out.withColumn("mix_copies", F.when(F.col("mix_rate") == 0, F.lit(0).cast("long")).otherwise(copies(F.col("mix_rate"), seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as many times as mix_copies says."""
    return mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.expr("sequence(1L, mix_copies)"))).select(*columns)


#: The same in DuckDB.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3)::INT] AS w FROM s),
o AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, 2.0 * source_size AS cap,
  coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS w_rest,
  row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS k FROM n),
f AS (SELECT coalesce(min(k), (SELECT max(k) + 1 FROM o)) AS k FROM o WHERE source_size > 0 AND w * (budget - cap_before) <= cap * w_rest),
g AS (SELECT o.source, source_size, CASE WHEN o.k < f.k THEN cap ELSE w * (SELECT budget - cap_before FROM o p WHERE p.k = f.k) / (SELECT w_rest FROM o p WHERE p.k = f.k) END AS target FROM o, f),
h AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS drawn
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM h
"""
