"""Queries of the operators for training text, with production parameters, over whole tables."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.frequencies import term_frequencies
from shelfmark.llm.leaks import leaks
from shelfmark.llm.pieces import split_texts
from shelfmark.llm.tokens import encode
from shelfmark.llm.variants import variant_pairs
from shelfmark.llm.visual import look_alike_pairs
from shelfmark.operators.packed import fold_column, packed_values, split_packed
from shelfmark.session import table


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of people and bodies: items of ``authors`` without a role in square brackets, and folded elements of the resources' authors."""
    items = packed_values(table(spark, sf_dir, "gutenberg_catalog"), ["authors"])
    a = items.select(F.regexp_replace("item", r"\s*\[[^\[\]]*\]$", "").alias("name"))
    b = table(spark, sf_dir, "discovery_validation").select(F.explode("authors").alias("name")).select(fold_column("name").alias("name"))
    return a.unionByName(b).filter("name IS NOT NULL AND name != ''")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different names of one person or body."""
    return variant_pairs(names(spark, sf_dir), "name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject, bookshelf and language tag with its occurrences, its texts and its mark."""
    catalog = table(spark, sf_dir, "gutenberg_catalog")
    items = split_packed(catalog, "row_id", ["subjects", "bookshelves"], carry=["text_num"])
    terms = items.select("field_name", F.col("item").alias("term"), F.col("text_num").alias("record"))
    tags = catalog.select(
        F.lit("languages").alias("field_name"), F.explode(F.split("languages", r"[;,|；，/\t\n]")).alias("term"), F.col("text_num").alias("record"))
    tags = tags.withColumn("term", fold_column("term")).filter("term != ''")
    n = catalog.agg(F.count_distinct("text_num")).first()[0]
    return term_frequencies(terms.unionByName(tags), n)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stored titles and of names that a reader sees as the same."""
    titles = table(spark, sf_dir, "gutenberg_catalog").select("title").unionByName(table(spark, sf_dir, "discovery_validation").select("title"))
    texts = titles.select(F.lit("title").alias("field_name"), F.col("title").alias("text")).unionByName(
        names(spark, sf_dir).select(F.lit("authors").alias("field_name"), F.col("name").alias("text")))
    return look_alike_pairs(texts, "field_name", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the evaluation items."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are split: those with a second piece."""
    pieces = split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", only_split=True)
    return pieces.filter("piece_no = 2").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text").drop("ids")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_pieces": p8_pieces}
SQL: dict[str, str] = {}
MODULES = [sys.modules[__name__]]
