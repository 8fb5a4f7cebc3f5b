"""From raw documents to packed sequences: five stages, each written and read again.

toxicity -> near duplicates -> benchmark decontamination -> pseudonyms -> packing

Every stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.  SQL cannot express the
first stage (a trained classifier), so there is no oracle; ``tests/llm`` holds the
operators against brute force and the stages on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workpanel.llm.common import shuffled, staged, table, unused
from workpanel.llm.decontamination import decontaminate
from workpanel.llm.ngram_join import ngram_components, row_mark
from workpanel.llm.packing import pack_documents
from workpanel.llm.pii import pseudonymise
from workpanel.llm.queries import fold, pii_key, tokenizer_file
from workpanel.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores below 0.5."""
    held = F.coalesce(fold(5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(fold(5) != 0).select("doc_id", "toxic")
    score = unused(docs, "_toxicity")
    return toxicity_scores(docs, ~held, labels, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word-shingle similarity 0.8: of the rows with
    the smallest id one, by the hash of its text.  Rows go by id and text, so a row stays
    if only other texts under its id go; of repeated rows (equal id and text) one stays.
    Rows without an id cannot be named and stay; texts without a word, null ones
    too, are in no group and stay."""
    groups = ngram_components(docs, n=5, percent=80).filter("group is not null and doc_id is not null")
    rank = F.struct("doc_id", "mark")
    # one row a group; written, so that the joins can split a hot group
    first = staged(groups.groupBy("group").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows"))
                   .filter("rows > 1").select("group", F.col("first.mark").alias("stays")), "first-of-group")
    marks = staged(groups.join(shuffled(first), "group").select("mark", (F.col("mark") == F.col("stays")).alias("stays")), "marks")
    gone = marks.filter("not stays").select("mark").distinct()
    # rows that repeat as a whole have one mark
    repeated = marks.filter("stays").groupBy("mark").count().filter("count > 1").select("mark")
    mark = unused(docs, "_mark")
    marked = docs.withColumn(mark, row_mark("doc_id", "text"))
    on = lambda other: F.col(mark) == other["mark"]
    kept = marked.join(shuffled(gone), on(gone), "left_anti")
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, on(repeated), "left_semi").dropDuplicates([mark])
    return kept.join(repeated, on(repeated), "left_anti").unionByName(once).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified stretch of a benchmark text.  Items of one or two
    different words say too little to cost a document its place."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), least_tokens=3).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced; ``n_chars`` follows the text."""
    hidden = pseudonymise(docs, pii_key(spark), count=None)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
