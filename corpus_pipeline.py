"""From raw documents to a mixed training corpus: each stage reads what the one before it wrote.

All stages take the columns of documents and any others, whatever their names, and keep them; an empty table stays one; texts of any length are read
whole; rows that share a doc_id, or have none, are documents of their own.  What null texts, ties and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, language_id, mixing, pii, simhash
from riskloom.session import fresh_path, scratch, table, written

#: A prediction with less than half of the probability is no decision.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undecided: no text, no letter, or no language with half of the probability (of two that tie neither has more).
    Repeated rows each stay or go."""
    guessed = language_id.identify(docs.select("doc_id", "text", "lang", F.struct("*").alias("_row")))
    return guessed.where((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def by_fingerprint(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, a null one last.  Of repeated rows one stays; of others that share the id the one
    whose hashes come first.  Null and wordless texts are one group."""
    return simhash.one_of_each(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, all rows of them; null and wordless texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def by_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; n_chars follows.  Repeated rows are redacted alike; a null text stays null, with its n_chars; of spans that
    begin at one place the longest counts."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Null and wordless texts have size 0 and are not taken; repeated rows are each taken on their own; rows of
    equal size stand in a fixed order of their contents."""
    return mixing.mix(docs)


STAGES = [("language_id", by_language), ("simhash", by_fingerprint), ("decontaminate", by_benchmark), ("pii", by_personal_data), ("mixing", by_weight)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus.  A stage's intermediates go as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage_{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and SimHash use hashes that SQL lacks; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None
