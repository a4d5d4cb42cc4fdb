"""Documents through quality rules, near-dedup, decontamination, mixing and token files, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.decontaminate import decontaminate
from weir.llm.quality import quality_rules
from weir.llm.queries_mixing import mixed
from weir.llm.queries_tokens import token_files
from weir.llm.shared import fresh, table, written
from weir.llm.simhash import one_of_each


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of documents, whatever characters are in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule.

    A null, empty or blank text goes, as it has too few words; repeated rows stay or go alike; a very long text is
    judged whole; further columns, whatever they are called, pass through; an empty table stays one.
    """
    into = fresh(docs, "quality")
    return quality_rules(docs, into=into).where(F.col(into)["kept"]).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of least id, a null id after all others.

    Texts that are null or blank are one group; of rows with the same id and text one stays, and rows that share an
    id but no text are apart; further columns pass through; an empty table stays one.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in the benchmark, without what is.

    A null or empty text has nothing to hide and stays as it is; repeated rows are treated alike; n_chars, if it is
    there, follows the text; other columns pass through; an empty table or benchmark is no special case.
    """
    into = fresh(docs, "leak")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), into=into).where(~F.col(into)["contaminated"])
    clean = {"text": F.col(into)["clean_text"]}
    if "n_chars" in docs.columns:
        clean["n_chars"] = F.when(F.size(F.col(into)["spans"]) > 0, F.char_length(F.col(into)["clean_text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(clean).select(_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights draw them.

    A text without words is not drawn; rows of one id and source are drawn together; a null language or source is
    one of its own; further columns pass through; an empty table stays one.
    """
    into = fresh(docs, "mix")
    copies = F.col(into)["copies"]
    drawn = mixed(docs, into).where(copies > 0)
    return drawn.withColumn(into, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's token ids lie in the files, as read back.

    A null or empty text has the end id alone; repeated rows are written as often as they occur; null ids come
    first; further columns are not read; an empty table makes no file.
    """
    return token_files(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token files", tokens),
]

#: XXH64 fingerprints and the tokenizer are not SQL; the test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
