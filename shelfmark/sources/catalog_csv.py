"""Strict reading of the nine-column catalogue CSV: one bad row fails the whole read."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scalars import date_shape, split_codes, split_list
from shelfmark.operators.packed import fold_column

HEADER = ["Text#", "Type", "Issued", "Title", "Language", "Authors", "Subjects", "LoCC", "Bookshelves"]
MOST_BYTES = 64 << 20


def check_local(path: str, most: int = MOST_BYTES) -> None:
    """Refuses anything but an absolute, regular file (no link) of 1..``most`` bytes."""
    if not os.path.isabs(path):
        raise ValueError("the path must be absolute")
    s = os.lstat(path)
    if not stat.S_ISREG(s.st_mode) or not 1 <= s.st_size <= most:
        raise ValueError("not a regular file of an allowed size")


@F.pandas_udf(T.StringType())
def _row_digest(row: pd.DataFrame) -> pd.Series:
    """SHA-256 of a row written again as CSV, quoted only where needed."""

    def one(values: tuple) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return hashlib.sha256(out.getvalue().encode()).hexdigest()

    return pd.Series([one(t) for t in row.itertuples(index=False)])


def read_catalog(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """Typed records of the catalogue. Header, field count, numbers, dates and uniqueness are all enforced."""
    if (found := spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns) != HEADER:
        raise ValueError(f"the header is {found}")
    schema = ", ".join(f"`{c}` string" for c in HEADER)
    raw = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
           .option("mode", "FAILFAST").csv(path))
    number = F.col("Text#").rlike("^[1-9][0-9]{0,7}$")
    issued = F.col("Issued").isNull() | date_shape("Issued")
    fine = F.coalesce(number & issued & F.col("Title").isNotNull(), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("bad catalogue row: "), F.coalesce("Text#", F.lit("no number")))).cast("boolean")
    # a filter, so that the check is made whatever columns are asked for
    out = raw.filter(F.when(fine, True).otherwise(bad)).select(
        F.col("Text#").cast("int").alias("num"), fold_column("Type").alias("kind"), F.col("Issued").alias("issued"), fold_column("Title").alias("title"),
        split_codes("Language").alias("languages"), split_list("Authors").alias("authors"), split_list("Subjects").alias("subjects"),
        split_list("LoCC").alias("classes"), split_list("Bookshelves").alias("shelves"), _row_digest(F.struct(*HEADER)).alias("row_sha256"))
    if unique and (twice := out.groupBy("num").count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"text number {twice[0]['num']} stands twice")
    return out
