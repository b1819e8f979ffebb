"""Corpus pipeline: classify, dedup lines, dedup documents, decontaminate, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage to the shared folder and reads it back, as stages are meant to be run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tidemark.llm.common import free_name, is_held_out, small, stored, table
from tidemark.llm.registry import quality_weights

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents with another text."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def has_words(text: Column) -> Column:
    """Whether a text has a word; null has none."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more).

    Null, empty and blank texts have statistics of zero and are judged by them like any text; equal texts are judged
    alike, so repeated rows stay or go together, and a score of exactly 0.5 stays. Null ids are judged too (they teach
    nothing). Without labels of both kinds the model is a constant, and all documents stay or go. An empty table stays
    empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id")))
    name = free_name(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, exactly or but for a word; texts that lose all their words go.

    Null, empty and blank texts have no line, lose none and stay. Of equal lines the one of the smaller id, then of the
    smaller line number stays; null ids come last. Rows that repeat an id and its text keep the same lines. An empty
    table stays empty.
    """
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = F.col("lines.text")
    return with_text(cleaned.where((F.col("lines.n_removed") == 0) | has_words(left)), left)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one of the smallest id.

    Of rows that repeat an id one stays too, the first by text, language and source (null first). Null, empty and blank
    texts link with nothing and stay, as do all rows without an id. An empty table stays empty.
    """
    groups = stored(near_dedup.near_duplicates(docs), "groups")
    gone = small(stored(groups.where(~F.col("kept")).select("doc_id").distinct(), "gone"))
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source"))
    once = kept.where("doc_id IS NOT NULL").withColumn("rank", rank).where("rank = 1").select(*COLUMNS)
    return once.unionByName(kept.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages of 10 words or more; documents that are mostly such passages go.

    Null and empty texts hold no passage and stay. Mostly is more than half of the words; exactly half stays. Each row
    is judged by its own text, so repeated rows stay or go together. An empty table, or an empty benchmark, changes
    nothing.
    """
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return with_text(found.where(~F.col("contamination.dropped")), F.col("contamination.clean_text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their words (size) and the words that the mix takes of them (taken, repeats counted).

    Documents of which nothing is taken go, so those without words (null, empty, blank) do. A null source is a source,
    the last. Ties of the sampling key go to the smaller id, then to fewer words; repeated rows count each. An empty table stays empty.
    """
    mix = mixing.mix(docs.select(*COLUMNS), quality_weights(spark, sf_dir), carry=("text", "lang", "n_chars"))
    return mix.where("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality", good_quality),
    ("lines", distinct_lines),
    ("near-duplicates", distinct_documents),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier and the sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
