"""A corpus from raw documents to token ids, a stage at a time.

Each stage takes all that the one before kept, as Parquet in the shared folder,
and its decisions take effect. No stage but the last changes the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, langid, mixing, simhash, suffix_dedup
from quantloom.llm.common import documents, drop_stage, stage


#: Words of a passage that may occur once only. One of over 50 words has as many
#: whole ones, also where an end is glued to another word.
PASSAGE_WORDS = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with a posterior of a half at
    least and letters as likely as in the language's sample. Null texts and those
    without a letter go. Rows that repeat stay or go together; without a labelled
    row all go; an empty table gives none; columns of any names stay."""
    return langid.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates, a null one only where
    the group has no other; of rows that repeat one. Null and wordless texts are
    one group. An empty table gives none; columns of any names stay."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that recur: all occurrences go, the
    first too, since which one is first says nothing about where it belongs. Null
    and empty texts, and texts without a repeat, stay as they are; rows that repeat
    lose their passages. An empty table gives none; columns of any names stay."""
    return suffix_dedup.remove_passages(docs, PASSAGE_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times;
    null and empty texts aren't taken. Rows that repeat are queued each; a null
    source is one of its own. An empty table gives none; columns of any names stay."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of what they decode to, a row a
    document; a null text counts as empty, columns but doc_id and text are left out,
    and an empty table gives none."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("source_mix", mixed),
    ("byte_bpe", token_ids),
]

#: No SQL: language, fingerprints and token ids can't be expressed in it. The
#: tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = documents(spark, sf_dir), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if read is not None:
            drop_stage(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
