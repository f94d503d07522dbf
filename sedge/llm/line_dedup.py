"""Line dedup by winnowing: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import WORD, Scratch

#: A run of lines with at least so many words counts as a repeat.
MIN_WORDS = 50
_NONE = 2**63 - 1


def _keys(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("t"))


def _packed(i: str, j: str) -> Column:
    """A run's two lines in one long, null if either is."""
    return F.shiftleft(F.col(i).cast("long"), 32).bitwiseOR(F.col(j).cast("long"))


def windows(docs: DataFrame, min_words: int, text: str) -> DataFrame:
    """Winnowing: every shortest run of lines that holds min_words words and starts, or ends, at a line with words, as
    document (d, h), first and last line i, j, its fingerprint f, and what is around the fingerprint.

    The fingerprint is the least line hash of the window (the first of equals) at its position q; as any run of
    min_words words or more holds a window, it holds a selected fingerprint.  `left` and `right` are hashes of the
    window's lines up to q and from q on.  Each line of min_words words before one without words, up to the next line
    with words, is a window too: then any run of min_words words or more that starts and ends with words is the union
    of the windows inside it.

    Lines leave their document as hashes; one shuffle brings a document's lines together, and grouping, ordering and
    both window functions reuse it.  A window's end is the first line whose running word count reaches that before the
    window plus min_words, found by one pass over ends and starts merged in falling order, its start by the mirrored
    pass.  Slices are cut before windows become rows, so a document costs its windows' lines, not their number times
    its length.
    """
    rows = _keys(docs, F.coalesce(F.col(text), F.lit("")))
    lines = rows.select("d", "h", F.posexplode(F.split("t", "\n", -1)).alias("i", "line"))
    lines = lines.select("d", "h", "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("2"), "line").alias("b"), F.regexp_count("line", F.lit(WORD)).alias("w"))
    lines = lines.repartition("d", "h").groupBy("d", "h", "i").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("w").alias("w"))
    of_doc = Window.partitionBy("d", "h")
    lines = lines.withColumn("upto", F.sum("w").over(of_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("bare", F.lead("w").over(of_doc.orderBy("i")) == 0)
    marks = F.array(F.struct(F.col("upto").alias("v"), F.lit(True).alias("end")), F.struct((F.col("upto") - F.col("w") + min_words).alias("v"), F.lit(False).alias("end")))
    further = F.array(F.struct((F.col("upto") + 1).alias("v"), F.lit(False).alias("end")))
    marks = F.when(F.col("bare") & (F.col("w") >= min_words), F.concat(marks, further)).otherwise(marks)
    marks = F.when(F.col("w") > 0, marks).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("v"), F.lit(True).alias("end"))))
    both = lines.withColumn("m", F.explode(marks))
    both = both.withColumn("j", F.min(F.when(F.col("m.end") & (F.col("m.v") >= 0), F.col("i"))).over(of_doc.orderBy(F.desc("m.v")).rangeBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("s", F.max(F.when(~F.col("m.end"), F.col("i"))).over(of_doc.orderBy("m.v").rangeBetween(Window.unboundedPreceding, 0)))
    run = F.when(~F.col("m.end"), _packed("i", "j")).when(F.col("m.v") >= 0, _packed("s", "i"))
    of_docs = both.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.when(F.col("m.end"), F.struct("i", "a", "b", F.col("w").alias("w"))))).alias("l"), F.collect_set(run).alias("runs"))
    of_docs = of_docs.where(F.size("runs") > 0)
    least = F.transform("l", lambda x: F.struct(F.when(x["w"] > 0, x["a"]).otherwise(F.lit(_NONE)).alias("f"), x["i"].alias("q")))
    arrays = of_docs.select("d", "h", "runs", least.alias("s"), F.transform("l", lambda x: x["a"]).alias("a"), F.transform("l", lambda x: x["b"]).alias("b"))
    at = "transform(runs, r -> struct(CAST(shiftright(r, 32) AS INT) AS i, CAST(r & 4294967295 AS INT) AS j))"
    at = f"transform({at}, r -> struct(r.i AS i, r.j AS j, array_min(slice(s, r.i + 1, r.j - r.i + 1)) AS x))"
    at = f"transform({at}, r -> struct(r.i AS i, r.j AS j, r.x.f AS f, xxhash64(slice(a, r.i + 1, r.x.q - r.i + 1)) AS left, xxhash64(slice(b, r.x.q + 1, r.j - r.x.q + 1)) AS right))"
    return arrays.select("d", "h", F.explode(F.expr(at)).alias("r")).select("d", "h", "r.*")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(d, h, dropped): for each document with any, the sorted line numbers to drop.

    Positions meet by fingerprint: a window whose fingerprint has no other position is unique and leaves.  From a shared
    fingerprint a match is extended both ways over the lines of its window: those with the same fingerprint and the same
    lines to its left and right are one repeat.  All but the first occurrence (by document, then line) are dropped;
    overlapping windows add up to the longest repeated run.  Groups are counted and led by pre-aggregated groupBys; the
    joins are equi-joins with tables unique in their key, which AQE splits where a fingerprint is frequent.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    runs = scratch.save(windows(docs, min_words, text), "windows")
    shared = runs.groupBy("f").agg(F.min(F.struct("d", "h", "i", "j")).alias("x"), F.max(F.struct("d", "h", "i", "j")).alias("y")).where("x != y").select("f")
    met = runs.join(shared, "f", "left_semi")
    first = met.groupBy("f", "left", "right").agg(F.min(F.struct("d", "h", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = met.join(first, ["f", "left", "right"]).where(~F.struct("d", "h", "i").eqNullSafe(F.col("first")))
    return later.groupBy("d", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("i", "j"))))).alias("dropped"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the cleaned text for every row of docs.

    A line goes if it lies in a run of consecutive lines, the first and last with words, that holds min_words words or
    more and occurs earlier, in a document with a smaller id (null smallest, ties by a hash of the text) or further up in
    the same one; the first occurrence stays.  An earlier occurrence may overlap the later one, so of one line repeated
    many times over its first copy stays.  A null text counts as one empty line and comes back empty; short documents
    and empty tables pass unchanged; rows equal in id and text are one document and come back alike.  A text costs its
    lines and its windows' lines, however long it is.  Extra columns are ignored.
    """
    found = repeats(docs, min_words, text).withColumnsRenamed({"d": "d2", "h": "h2"})
    rows = _keys(docs, F.coalesce(F.col(text), F.lit("")))
    both = rows.join(found, rows["d"].eqNullSafe(found["d2"]) & (rows["h"] == found["h2"]), "left")
    both = both.withColumn("line", F.split("t", "\n", -1)).withColumn("gone", F.coalesce("dropped", F.array().cast("array<int>")))
    both = both.withColumn("ends", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("line"))))
    kept = F.expr("array_join(flatten(transform(sequence(0, size(gone)), k -> slice(line, ends[k] + 2, ends[k + 1] - ends[k] - 1))), '\n')")
    return both.select(F.col("d").alias("doc_id"), F.size("line").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.when(F.size("gone") == 0, F.col("t")).otherwise(kept).alias("text"))


#: The same in DuckDB, from every window's lines themselves.
DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM t),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
e AS (SELECT doc_id, i, upto FROM c WHERE w > 0),
r AS (SELECT s.doc_id, s.i, e.i AS j FROM (SELECT doc_id, i, upto - w + 50 AS need FROM c WHERE w > 0) s ASOF JOIN e ON s.doc_id = e.doc_id AND s.need <= e.upto),
x AS (
  SELECT * FROM r
  UNION SELECT e.doc_id, s.i, e.i FROM (SELECT *, upto - 50 AS have FROM e) e ASOF JOIN (SELECT doc_id, i, upto - w AS before FROM c WHERE w > 0) s ON e.doc_id = s.doc_id AND e.have >= s.before
  UNION SELECT * FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM c WHERE w > 0) WHERE j IS NOT NULL AND (doc_id, i) IN (SELECT (doc_id, i) FROM c WHERE w >= 50)
),
k AS (SELECT r.doc_id, r.i, r.j, array_to_string(t.lines[r.i:r.j], chr(10)) AS run FROM x r JOIN t USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM n WHERE nth > 1)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_dropped, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
