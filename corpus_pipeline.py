"""A training-corpus pipeline: five stages over `documents`, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, and carry further columns whatever their names. doc_id names a document: rows that repeat a doc_id are kept or
dropped together, where a stage drops by id. Empty tables pass through every stage; whole texts count, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import staged, table
from voxlake.llm.decontamination import contamination
from voxlake.llm.jaccard_join import jaccard_components
from voxlake.llm.language import UND, learn_languages, with_language
from voxlake.llm.packing import pack_documents
from voxlake.llm.secrets import redact_secrets
from voxlake.llm.sieve import only_maybe
from voxlake.llm.tokens import vocabulary

#: Share of a text's letters that its language must hold.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in which no language holds a fair share of the letters.

    Null and empty texts have no letter and go; rows are judged one by one, so copies and rows without doc_id are judged by
    their own text. Where no row has a known language, every text with a letter stays.
    """
    model = learn_languages(docs)
    if not model.languages:  # nothing to tell languages by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = with_language(docs, model)
    return named.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of least id.

    Rows without doc_id and texts without words belong to no group and stay; of equal texts the least doc_id stays.
    """
    found = jaccard_components(docs)
    gone = staged(found.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    maybe, stay = only_maybe(docs, "doc_id", gone, "doc_id", gone.count())
    return stay.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null, empty and short texts hold none, and rows without doc_id are not judged; an empty benchmark drops nothing.
    """
    leaks = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, null texts stay null, and n_chars follows a changed text."""
    return redact_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document; a null text counts as empty and has one piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: No SQL: language models and tokenizers are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
