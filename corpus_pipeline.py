"""Documents to token ids in four stages: language, near duplicates, benchmark passages, word BPE.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept. All but the last return rows of
``docs`` as they are; what a stage returns is written to the shared folder and read again as the next stage's docs.

Defined results: documents with null or empty text, or without a letter, are rejected by the language stage; of
repeated rows and of near copies the row with the smallest doc_id stays; documents without doc_id stay unless they copy
another; extra columns travel along to the last stage, which returns doc_id, lang, source and the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyveil.llm.common import table, written
from tallyveil.llm.decontaminate import clean_documents
from tallyveil.llm.language import accept_documents
from tallyveil.llm.near_dedup import one_of_each
from tallyveil.llm.word_lexicon import build_lexicon, coded


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: more likely one of the learned languages than all others together."""
    return accept_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and the digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return coded(docs, path, build_lexicon(docs, path), keep=("doc_id", "lang", "source"), ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("word_bpe", tokens)]
#: The language model and the tokenizer are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
