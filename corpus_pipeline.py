"""A corpus pipeline: each stage reads the documents that the one before it kept.

All stages but the last return the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language, near_dup, packing, quality
from gridloom.llm.common import Scratch, bitmap, checkpointed, marked

#: A document whose average word says less than this for its language is rejected, as is one without letters.
MIN_SCORE = 0.4
#: Shared shingles, in percent of those of either, that make two documents near copies.
NEAR_PERCENT = 80


def _rows(docs: DataFrame) -> DataFrame:
    """docs as (__row, doc_id, text): whole rows in one column, so that no name of theirs can clash with
    an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is likely; `und` goes, hence null, empty and letterless texts.

    Rows are judged one by one, so repeated rows and null ids are kept or go like any other; all
    columns stay as they are, whatever their names; no documents give none.
    """
    model = language.learn(docs.where(~language.held_out()))
    said = language.predicted(spark, model)(F.col("text"))
    judged = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), said.alias("said"))
    kept = judged.where((F.col("said.lang_pred") != "und") & (F.col("said.score") >= MIN_SCORE))
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail one; n_chars, if there, counts anew.

    A null text counts as empty and goes. Rows are judged one by one; all other columns stay as they
    are, whatever their names; no documents give none.
    """
    # exploded, so that the filter is not pushed below the cleaning and the cleaning not done twice
    judged = docs.select(F.explode(F.array(quality.cleaned(F.col("text")))).alias("cleaned"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return judged.where("cleaned IS NOT NULL").select(*(new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their shingles the document with the smallest id.

    Rows that share a doc_id stay or go together, rows without one stay, and texts without a word
    are nobody's copy. All columns stay as they are; no documents give none.
    """
    gone = checkpointed(near_dup.near_duplicates(docs, NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct())
    # a filter of fixed size tells most rows that stay, so that only the others are shuffled
    key = F.xxhash64("doc_id")
    seen = checkpointed(bitmap(gone.select(key.alias("h")), "h"))
    rows = marked(_rows(docs).drop("text").withColumn("h", key), "h", seen, "again")
    stay = rows.where("NOT again").select("__row").union(rows.where("again").join(gone, "doc_id", "left_anti").select("__row"))
    return stay.select("__row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`.

    Null and empty texts hold none; rows are judged one by one; all columns stay as they are,
    whatever their names; no documents, or no benchmark, leave nothing out.
    """
    found = decontaminate.decontaminate(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.where(~F.col("contaminated")).select("__row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null text is one piece of one token, repeated rows are
    packed as often as they occur, other columns are left out, and no documents give no pieces."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn, hash and pack; SQL cannot express them. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name.split()[0].lower())
        return checkpointed(STAGES[-1][1](spark, docs, sf_dir))
