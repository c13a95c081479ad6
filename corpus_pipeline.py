"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import op4_decontaminate, op5_minhash, op6_language, op7_tokens, op8_mixing, store


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised, by a model of the labelled ones; those rejected go.

    Null and empty texts and texts without a letter are rejected.  Long texts are read whole.  Repeated rows and null ids
    are judged row by row; extra columns stay.  With no labelled row there is nothing to tell languages by, and every row
    stays.  An empty table stays empty.
    """
    rows = op6_language.sample(docs)
    return op6_language.keep_identified(docs, op6_language.train(rows)) if rows else docs


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: five-word shingles, similarity 0.8 or more.

    The least doc_id stays; a null id comes last.  Different texts under one id, or without an id, are documents of their own; of
    rows that repeat id and text one stays.  Null and empty texts are alone in their component and all stay.  Long texts
    are compared whole; extra columns stay.  An empty table stays empty.
    """
    return op5_minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark passage.

    Null and empty texts are clean.  Rows are judged one by one, so repeated rows and null ids make no difference; long
    texts are searched whole; extra columns stay.  Without benchmark items everything stays.
    """
    return op4_decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum takes them, whole, and repeated to come near to the sources' targets, in training order.

    Documents without words are never taken; a null source is a source.  Rows that repeat id and text are documents of
    their own, told apart by a number.  Long texts are taken whole or not at all; extra columns stay.  An empty table
    stays empty.
    """
    return op8_mixing.mixed_documents(docs, uncut=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: one row a row.

    A null text has the end id only, a null id comes first, rows that repeat an id are all written, in the order of a hash
    of the text.  Long texts are encoded whole.  An empty table gives no rows.
    """
    return op7_tokens.token_output(docs)


STAGES = [("language_id", identify), ("minhash_near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix), ("token_output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the trained model, the components and the tokenizer can't be expressed in it.
ORACLE_SQL = None


QUERIES = {"pipeline": run}
