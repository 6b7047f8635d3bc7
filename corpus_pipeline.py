"""From raw documents to packed sequences: quality classifier, line rules, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.llm import curriculum, histogram_pack, line_rules, nbsvm, t_occurrence
from regfeed.llm.common import read, stored
from regfeed.session import broadcast_if_small, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``nbsvm.CUT`` or more, by a model fitted on their labelled, not held out rows.

    Every row is scored by its own text, whatever its id: NULL and repeated ids are kept or go each by itself. A NULL text scores as an
    empty one. Rows without an id have no label.
    """
    tune(spark)
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    return nbsvm.score(docs.select(COLUMNS), model).where(F.col("score") >= nbsvm.CUT).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that failed; ``n_chars`` counts what is left.

    Every row is judged by its own text, whatever its id. NULL and empty texts have no words and go.
    """
    tune(spark)
    judged = line_rules.line_first(docs.select(COLUMNS), with_text=True).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.char_length("clean_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 on five-word shingles: the one with the smallest id.

    Documents without an id stay. Rows of one id are one document: all of them stay or go.
    """
    tune(spark)
    groups = t_occurrence.jaccard_groups(docs, width=5, percent=80).where("component_id < doc_id")
    copies = stored(groups.select("doc_id").distinct(), "copies")
    return docs.select(COLUMNS).join(broadcast_if_small(copies), "doc_id", "left_anti").select(COLUMNS)


def row_key() -> Column:
    """Equal for rows that agree in every column, which are interchangeable, and different for any two others."""
    text = F.md5(F.col("text").cast("binary")).alias("text")
    return F.md5(F.to_json(F.struct("doc_id", "lang", "source", "n_chars", text)).cast("binary"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; what it does not take goes.

    Each row is taken as often as it is due, also if its id is NULL or that of another row. NULL texts have size 0; a NULL source is a
    source.
    """
    tune(spark)
    keyed = docs.select(COLUMNS).withColumn("_key", row_key())
    # Only keys and sizes go through the sums; texts are moved by one join and the final sort.
    sized = stored(curriculum.word_counts(keyed, "_key"), "sizes")
    mixed = curriculum.mix(sized, curriculum.source_targets(sized)).where("passes > 0")
    times = stored(mixed.select("_key", "positions"), "positions")
    # Of rows that agree in everything one text meets the positions of all.
    again = broadcast_if_small(stored(sized.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "repeated"))
    one = keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"])
    texts = keyed.join(again, "_key", "left_anti").unionByName(one)
    return curriculum.training_order(texts.join(times, "_key")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 ids. A document that the mix repeats is packed as often.

    Each row is packed, whatever its id; a NULL text is an empty one.
    """
    return histogram_pack.pack_documents(docs, capacity=4_096)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# A fitted model and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
