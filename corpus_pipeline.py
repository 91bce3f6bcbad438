"""The corpus pipeline: documents to a training mix.

Each stage takes what the one before it kept, written as Parquet and read again, and all but the last return
the columns of documents. Null and empty texts go in the first stage, as they have no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.llm import decontaminate, langid, linededup, mixing, neardup
from taleweave.llm.common import free_name, table, written

#: Above this many bits a byte, the best model finds no language in a text: prose of a known language has 2 to
#: 3 bits, random letters and digits have 6 or more.
MOST_BITS = 6.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, and those that no language predicts, go."""
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2))
    # other names, as the columns of the result could be taken
    rows = docs.toDF(*(f"__{c}" for c in docs.columns))
    found = langid.identify(rows, model, text="__text", keys=tuple(rows.columns))
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("bits_per_byte") <= MOST_BITS)).select(*rows.columns).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines like earlier ones; a document of which nothing but blank lines is left goes.

    Null ids come before all others, rows with one id are one document, and repeated rows get the same text.
    """
    removed = F.col(free_name(docs, "n_removed"))
    found = linededup.dedup_lines(docs).where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash, then MinHash; five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id that is not null stays, of several texts of it the one with the least hash, and one of repeated rows.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; a null text is clean, and repeated rows stay or go together."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(free_name(docs, "contaminated"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (``copies``) and their words; null is a source, and a text without words is not taken."""
    return mixing.mix_sources(docs).where(F.col(free_name(docs, "copies")) > 0)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", drop_contaminated), ("mix", mix)]

#: The stages train a model, follow links and solve for multipliers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
