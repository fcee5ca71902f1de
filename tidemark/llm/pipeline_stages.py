"""Stages of the corpus pipeline: each takes documents and returns those that it keeps, with the same columns.

Defined results, of all stages: an empty table gives an empty one; other columns than COLUMNS are dropped; rows are looked
at one by one, so an id may be null or be shared by several texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid
from .queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the best language's ridge output is at least this: about 1 for a text like those of the language, about
#: 0 for one in no learned language, however many languages there are.
MIN_OUTPUT = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents at hand; drop those without a letter or in no language that was learned.

    A null or empty text goes. Without a labelled document nothing is learned, so all go. Repeated rows stay or go alike.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    kept = langid.predict(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("output") >= MIN_OUTPUT))
    return kept.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows with a null id and empty texts stay; of rows that repeat an id and a text one stays; a row that shares an id with
    others and is no copy of a row that stays, stays too (near_dedup.keep_one).
    """
    from . import near_dedup as dedup

    return dedup.keep_one(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from no time to twice; a null source is a source of its own, which comes last."""
    from . import mixing as mix

    return mix.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row a row; a null text counts as empty."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
