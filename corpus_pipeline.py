"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes all rows that its predecessor kept, and its decisions take effect: documents without a language go;
later copies of repeated line runs, of one word or more, are cut out of the texts, and documents of which nothing is left go; of each group of
near-duplicates the document with the smallest id stays; documents with a benchmark item in them go; the rest is packed.
Decisions hold for an id with its text: rows without an id, or that share one, are judged each by their own text.
All stages but the last return the columns of documents, with n_chars as the length of the text as it now is; extra columns
are kept, whatever their names. Ties go to the smallest id; rows that repeat an id and its text count once in the join and
stay together elsewhere. Empty tables, of documents or benchmark items, pass through every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.llm.common import columns, cut, fresh, hand_back, small, table, trim_workers
from obsq.llm.decontaminate import leaks
from obsq.llm.language_id import identified
from obsq.llm.line_dedup import deduplicated
from obsq.llm.ngram_join import JaccardJoin
from obsq.llm.packing import op9_packing
from obsq.llm.queries import tokenizer_file

#: Near-duplicates share four fifths of their shingles of five words.
SHINGLE, NUM, DEN = 5, 80, 100
#: Every repeated line that isn't blank counts.
MIN_WORDS = 1
#: Stages that run no Python on the executors, not to hand memory back either.
NATIVE = {"lines"}


def stage(f):
    """A stage that begins with executors as small as the stages before it can leave them."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hand_back(spark)
        if f.__name__ not in NATIVE:
            trim_workers(spark)
        return f(spark, docs, sf_dir)

    return run_stage


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text, and that column's name, which none of theirs has."""
    (key,) = fresh(docs, "pipeline_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those with null text or without letters go."""
    return identified(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents that lose every line go."""
    had, lost = fresh(docs, "lines", "deleted")
    out = deduplicated(docs, MIN_WORDS, (had, lost)).where((F.col(lost) == 0) | (F.col(lost) < F.col(had)))
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, columns(docs))))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id, null last; rows that repeat an id and its text count once."""
    keyed, key = _keyed(docs)
    found = JaccardJoin(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, NUM, DEN).link()
    found = cut(found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"), "groups")
    ids = keyed.select(F.col(key).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    first = found.distinct().join(ids.hint("merge"), "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("m")).select(F.col("m.row").alias("row"))
    gone = cut(found.select("row").distinct().join(first.hint("merge"), "row", "left_anti").withColumnRenamed("row", key), "gone")
    kept = keyed.join(gone.hint("merge"), key, "left_anti")
    again = cut(found.groupBy("row").count().where("count > 1").select(F.col("row").alias(key)), "repeated")
    if again.isEmpty():
        return kept.select(*columns(docs))
    once = kept.join(again.hint("merge"), key, "left_semi").dropDuplicates([key])
    return kept.join(again.hint("merge"), key, "left_anti").select(*columns(docs)).unionByName(once.select(*columns(docs)))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item leaks."""
    keyed, key = _keyed(docs)
    bad = cut(leaks(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(small(bad), key, "left_anti").select(*columns(docs))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op9 returns them."""
    return op9_packing(spark, docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontaminate", decontaminate), ("packing", pack)]

#: Language, near-duplicates by signatures and token ids can't be had in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = cut(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
