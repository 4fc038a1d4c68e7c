"""Queries over texts and listings, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import listings, mixing, packing, residue, tokens
from skeinworks.session import written
from skeinworks.sources.tables import table


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of offers that sell the same drive model."""
    return listings.same_model(listings.grouped(table(spark, directory, "offers")))


def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    """The model of each offer of a drive, one row per offer, with the parsed attributes."""
    return listings.grouped(table(spark, directory, "offers"))


def _packs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, directory, "documents").select("doc_id", tokens.n_tokens(F.col("text")).alias("tokens"))
    capacities = table(spark, directory, "pack_sizes")
    return packing.packed(written(docs, "tokens"), "doc_id", "tokens", capacities, "pack_name", "capacity_tokens"), capacities


def p7_packs(spark: SparkSession, directory: str) -> DataFrame:
    """The pack of every piece of every document, for each capacity."""
    return _packs(spark, directory)[0]


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the packs of each capacity are."""
    packs, capacities = _packs(spark, directory)
    return packing.fill(packs, capacities, "pack_name", "capacity_tokens")


def _mix(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    text = F.col("text")
    docs = table(spark, directory, "documents").where("text is not null").select("doc_id", "source", tokens.n_tokens(text).alias("size"), mixing.quality(text).alias("weight"), F.sha2("text", 256).alias("text_hash"))
    targets = table(spark, directory, "mix_targets")
    return mixing.mixed(docs, targets, "doc_id"), targets


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The texts of the mix and how many times each is used."""
    return _mix(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share of all tokens that each source reached."""
    return mixing.shares(*_mix(spark, directory))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that are or hold leftovers of templates, filler, error pages or script notices."""
    return residue.marked(table(spark, directory, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """The kinds of residue of each such document."""
    return residue.marked(table(spark, directory, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p5_found, p5_groups, p7_packs, p7_fill, p8_mix, p8_shares, p9_found, p9_kinds)}
ORACLE_SQL: dict[str, str] = {}
