"""Deletion of repeated runs of lines by a suffix array over line ids, in DataFrame functions alone (operator 4).

Each line that occurs more than once gets an id, a document is the sequence of its ids, and all documents together are the
text whose suffixes are sorted. Prefix doubling ranks every suffix by its first 1, 2, 4, ... lines: the pairs of ranks of
the two halves are sorted over the cluster, and a pair's place is the rank for twice the length. Suffixes whose prefix
occurs nowhere else drop out in each round. Ranks are made up to the longest run that is looked up, so they are the suffix
array to that depth; suffixes with at least n lines in common are an interval of it, with a longest common prefix of n or
more, and the ranks of the first and the last 2^t of those n lines, which overlap, tell which interval a suffix lies in. The
first suffix of an interval, by doc_id and place, is the copy that stays; the lines of the others are deleted.

A run counts if it has at least `min_words` words. It is enough to look at the shortest such run that begins at each
line and the shortest that ends at each line: every line of a maximal repeated run lies in one of those within it, and
each of those is in the run's other copies too, as it follows from the lines alone. So just the lengths of these runs
are looked up, and what is deleted is every later copy of each maximal repeated run, whole.

Lines are told apart by 128 bits of hash. No group is gathered: an interval is a count and its least place, and pairs of
ranks are counted before they are sorted, so a line that stands everywhere is one row there. Ids and intervals grow with
the corpus, so they are joined by sorting both sides, whatever their size, and Spark splits the partitions of very common
lines.

Defined cases: a null text stays null, with no lines; rows with equal doc_id and equal text are one document and get
equal results; a null doc_id comes last in the order; where copies overlap, the later one's lines go; lines are compared
as they are, with words between single spaces; an empty table gives no rows; columns keep their names and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import columns, cut, discard, fit_columns, fresh, release

_LAST = (1 << 63) - 1


def _key(df: DataFrame):
    return F.xxhash64(df["doc_id"], df["text"])


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """The values of `by` that occur more than once, and their place among these, in `rank`: larger for later ones."""
    often = rows.where(F.col(by[-1]).isNotNull()).groupBy(*by).count().where("count > 1").select(*by)
    return cut(often.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """key (of doc_id and text) and place, from 0, of every line to delete."""
    split = docs.where(docs["text"].isNotNull()).select(_key(docs).alias("key"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), F.posexplode(F.split(docs["text"], "\n", -1)).alias("at", "line"))
    spaces = F.length("line") - F.length(F.translate("line", " ", ""))
    words = F.when(F.trim("line") == "", 0).otherwise(spaces + 1).cast("long")
    lines = cut(split.select("key", "doc", "at", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("other"), words.alias("words")), "lines")
    common = _ranked(lines, "id", "other")
    active = lines.join(common.hint("merge"), ["id", "other"]).drop("id", "other").withColumnRenamed("rank", "id")
    active = active.repartition("key").dropDuplicates(["key", "at"])

    # Stretches of lines that all occur elsewhere, and in them the shortest runs with enough words.
    active = active.withColumn("stretch", F.col("at") - F.row_number().over(W.partitionBy("key").orderBy("at")))
    of = W.partitionBy("key", "stretch")
    upto = F.sum("words").over(of.orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    active = active.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead, behind = of.orderBy("before").rangeBetween(0, min_words - 1), of.orderBy("upto").rangeBetween(W.unboundedPreceding, -min_words)
    active = (
        active.withColumn("last", F.max("at").over(ahead))
        .withColumn("reached", F.max("upto").over(ahead) - F.col("before"))
        .withColumn("first", F.coalesce(F.max("at").over(behind) + 1, F.min("at").over(of)))
    )
    active = cut(active.select("key", "doc", "at", "id", "stretch", F.when(F.col("reached") >= min_words, F.col("last")).alias("last"), F.when(F.col("upto") >= min_words, F.col("first")).alias("first")), "active")
    discard(lines, common)
    release(docs.sparkSession)
    forward = active.where("last is not null").select("key", "doc", F.col("at").alias("s"), (F.col("last") - F.col("at") + 1).alias("n"))
    backward = active.where("first is not null").select("key", "doc", F.col("first").alias("s"), (F.col("at") - F.col("first") + 1).alias("n"))
    runs = forward.union(backward).distinct()

    # Prefix doubling: element t of ranks is the rank of the 2^t lines from here, null where they occur nowhere else.
    longest = active.agg(F.max(F.greatest(F.col("last") - F.col("at"), F.col("at") - F.col("first"))) + 1).first()[0] or 1
    levels = int(longest).bit_length()
    ranks = active.select("key", "at", "stretch", F.array("id").alias("ranks"))
    for t in range(1, levels):
        half = F.element_at("ranks", t)
        pairs = ranks.withColumn("x", half).withColumn("y", F.lead(half, 1 << (t - 1)).over(W.partitionBy("key", "stretch").orderBy("at")))
        pairs = pairs.withColumn("y", F.when(F.col("x").isNotNull(), F.col("y")))
        made = _ranked(pairs, "x", "y")
        longer = cut(pairs.join(made.hint("merge"), ["x", "y"], "left").select("key", "at", "stretch", F.concat("ranks", F.array("rank")).alias("ranks")), "suffixes")
        discard(made, ranks)
        ranks = longer
    ranks = ranks.drop("stretch")
    runs = runs.withColumn("t", F.length(F.bin("n")) - 1)
    runs = runs.join(ranks.withColumnRenamed("at", "s").withColumnRenamed("ranks", "left"), ["key", "s"]).withColumn("x", F.element_at("left", F.col("t") + 1)).drop("left").where("x is not null")
    runs = runs.withColumn("e", (F.col("s") + F.col("n") - F.pow(F.lit(2), "t")).cast("int"))
    if levels == 1:
        runs = runs.withColumn("y", F.col("x"))
    else:
        runs = runs.join(ranks.withColumnRenamed("at", "e").withColumnRenamed("ranks", "right"), ["key", "e"]).withColumn("y", F.element_at("right", F.col("t") + 1)).drop("right").where("y is not null")
    runs = cut(runs.select("key", "doc", "s", "n", "x", "y"), "runs")
    discard(ranks, active)

    # Intervals of the suffix array with a longest common prefix of n lines; all suffixes but the first are later copies.
    place = F.struct("doc", "key", "s")
    intervals = cut(runs.groupBy("n", "x", "y").agg(F.min(place).alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "intervals")
    later = runs.join(intervals.hint("merge"), ["n", "x", "y"]).where(place > F.col("kept"))
    return later.select("key", F.explode(F.sequence(F.col("s"), (F.col("s") + F.col("n") - 1).cast("int"))).alias("at")).distinct()


def deduplicated(docs: DataFrame, min_words: int = 10, made: tuple[str, str] = ("_lines", "_deleted")) -> DataFrame:
    """The documents with later copies deleted, and how many lines there were and how many went, named as `made` says."""
    lost = cut(repeated_lines(docs, min_words).groupBy("key").agg(F.collect_set("at").alias("gone")), "deleted")
    key, gone = fresh(docs, "line_dedup_key", "line_dedup_gone")
    split, at = F.split("text", "\n", -1), F.col(gone)
    both = docs.withColumn(key, _key(docs)).join(lost.select(F.col("key").alias(key), F.col("gone").alias(gone)).hint("merge"), key, "left")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(at, i)), "\n")
    text = F.when(at.isNull(), F.col("text")).when(F.size(at) == F.size(split), F.lit("")).otherwise(kept)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    old = [text.alias("text") if c == "text" else x for c, x in zip(docs.columns, columns(docs))]
    return both.select(*old, lines.alias(made[0]), F.coalesce(F.size(at), F.lit(0)).cast("long").alias(made[1]))


def op4_line_dedup(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id, n_lines, n_deleted, text without later copies."""
    return deduplicated(fit_columns(docs, "doc_id", "text"), min_words, ("n_lines", "n_deleted")).select("doc_id", "n_lines", "n_deleted", "text")


#: The same in SQL, by comparing lists of lines; {words} is min_words.
ORACLE = """
WITH l AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), e AS (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM l
), w AS (
    SELECT doc_id, lines, pos, CASE WHEN trim(lines[pos], ' ') = '' THEN 0 ELSE length(lines[pos]) - length(replace(lines[pos], ' ', '')) + 1 END AS words FROM e
), p AS (
    SELECT doc_id, lines, pos, words, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w
), r AS (
    SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= {words} GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= {words} GROUP BY b.doc_id, b.pos
), c AS (
    SELECT r.doc_id, s, e, list_slice(l.lines, s, e) AS run FROM r JOIN l ON r.doc_id = l.doc_id
), f AS (
    SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM c
), g AS (
    SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(s, e + 1)) AS pos FROM f WHERE k > 1) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_deleted,
       CASE WHEN g.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(list_transform(range(1, len(l.lines) + 1), lambda i: CASE WHEN list_contains(g.gone, i) THEN NULL ELSE l.lines[i] END), lambda x: x IS NOT NULL), chr(10)), '') END AS text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
