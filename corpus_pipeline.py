"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of documents. run() writes every
stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import minhash, mixing, quality_pu, templates, token_files
from panelspark.llm.common import fresh_path, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores at least 0.7.

    A null text scores as an empty one; a null id has no label; repeated rows
    have one score; columns of any name and type stay; empty tables stay empty.
    """
    return quality_pu.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Null and wordless texts stay, as do rows that repeat the kept id and text; a
    null id gives way to any other; columns of any name and type stay; empty
    tables stay empty.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its numbers, names and units.

    Null and wordless texts stay; repeated rows stay or go together; null ids
    are judged by their own text; columns of any name and type stay; empty
    tables stay empty, and an empty benchmark takes nothing away.
    """
    return templates.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: a document is there once for each pass over it that the budget takes.

    Null and wordless texts are not in the mix; null sources are one source;
    rows that repeat an id within a source are taken together; columns of any
    name and type stay; empty tables stay empty.
    """
    return mixing.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them a row per document: doc_id, start, n_tokens, ids_crc32.

    A null text has the end id alone; null ids come first, equal ones in the
    order of their text; other columns do not matter; an empty table gives an
    empty result.
    """
    out = fresh_path(spark, "mix-tokens")
    token_files.write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.token_index(spark, out)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to weights", mixing_to_weights),
    ("token output", token_output),
]

#: Hash signatures, training and the tokenizer have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {}
