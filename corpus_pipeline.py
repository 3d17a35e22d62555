"""From documents to packed training sequences: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.  A stage takes whatever the
one before kept.  Defined results: null and empty texts pass every filter; a document that loses all its lines stays, with an
empty text; rows without an id are never duplicates; an empty table stays empty; other columns are carried along untouched
(n_chars follows the text, where there is one).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.llm.common import staged, table
from slidespark.llm.decontaminate import drop_contaminated
from slidespark.llm.jaccard_join import jaccard_join
from slidespark.llm.line_dedup import line_dedup
from slidespark.llm.packing import pack
from slidespark.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")), 0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document only."""
    done = line_dedup(docs, carry=True)
    row = F.col("row").withField("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return done.select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    groups = jaccard_join(docs, words=5, num=80, den=100)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: toxicity is a trained model and packing is sequential.  tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
