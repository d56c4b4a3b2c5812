"""Append-only JSON-lines journals: numbered, canonical, complete lines only; and strict JSON documents."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions.codecs import is_canonical_udf, strict_json
from shelfmark.session import cut
from shelfmark.sources.catalog_csv import check_local

MOST_TAIL = 64 << 10


def journal_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, line`` of the journals under a path; a torn last line is left out.

    A last line without a line feed was never committed, one above the limit is an error, as are bytes that are no UTF-8.
    Files are read in blocks and written once as a table, so no task holds one: a line's number is its place in its block
    after the lines of all blocks before. What is broadcast has a row for each block.
    """
    m = F.col("_metadata")
    read = spark.read.text(path, lineSep="\n").select(m["file_path"].alias("at"), m["file_size"].alias("size"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"),
                                                      F.octet_length("value").cast("long").alias("bytes"), F.col("value").alias("line"))
    lines = cut(read)  # ids count on within a block only where it was read
    blocks = lines.groupBy("at", "size", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes") + 1).alias("b"))
    of_file = Window.partitionBy("at")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a line feed is counted for every line: one more than the bytes if the last has none, three less if the reader left out a byte order mark
    blocks = blocks.select("at", "block", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(of_file).alias("of"), (F.sum("b").over(of_file) - F.col("size")).alias("over"))
    blocks = _required(blocks, F.col("over").isin(0, 1, -3, -2), F.concat(F.lit("the lines are not the bytes of "), F.col("at")))
    j = lines.join(F.broadcast(blocks), ["at", "block"]).withColumn("no", (F.col("id") + F.col("shift")).cast("int"))
    marked = F.when((F.col("over") < 0) & (F.col("no") == 1), F.concat(F.lit("\ufeff"), F.col("line"))).otherwise(F.col("line"))
    torn = F.col("over").isin(1, -2) & (F.col("no") == F.col("of"))
    whole = (F.when(torn & (F.col("bytes") > MOST_TAIL), F.raise_error(F.lit("the unfinished last line is too long")))
             .when(torn, F.lit(None)).when(~F.is_valid_utf8("line"), F.raise_error(F.concat(F.lit("no UTF-8 in line "), F.col("no").cast("string"))))
             .otherwise(F.array(F.struct(F.col("no").alias("line_no"), marked.alias("line")))))
    # no filter of a caller comes before an explode, so none sees a torn line
    return j.select(F.url_decode(F.replace("at", F.lit("+"), F.lit("%2B"))).alias("file"), F.explode(whole).alias("x")).select("file", "x.line_no", "x.line")


def read_journal(spark: SparkSession, path: str, schema: StructType | str, canonical: bool = True) -> DataFrame:
    """Records of a journal with ``file`` and ``line_no``; an unreadable or non-canonical line fails the read."""
    lines = journal_lines(spark, path)
    if canonical:
        lines = _required(lines, is_canonical_udf("line"), F.concat(F.lit("line is not canonical: "), F.col("line_no").cast("string")))
    # the filter needs the parsed record, so a bad line fails the read whatever columns are asked for
    return lines.select("file", "line_no", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).filter("r IS NOT NULL").select("file", "line_no", "r.*")


def _required(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """``df``, failing on a row that is not ``ok``. The check is a filter: no choice of columns prunes it away."""
    message = F.lit(message) if isinstance(message, str) else message
    return df.withColumn("_ok", ok).filter(F.when(F.col("_ok"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_ok")


def check_sequence(df: DataFrame, sequence: str, by: str = "file") -> DataFrame:
    """``df``, the lines of whole journals, failing where the sequence isn't 1..n in line order: in a file, the lines' own numbers."""
    at = F.col("line_no") if by == "file" else F.row_number().over(Window.partitionBy(by).orderBy("line_no"))
    return _required(df, F.coalesce(F.col(sequence) == at, F.lit(False)), F.concat(F.lit("sequence broken at "), F.coalesce(F.col(sequence).cast("string"), F.lit("a null"))))


def check_pairs(df: DataFrame, event: str, first: str, second: str, same: list[str]) -> DataFrame:
    """``df`` of pairs ``first``, ``second`` in line order, failing where a pair doesn't agree in ``same``."""
    w = Window.partitionBy("file", F.expr("(line_no + 1) div 2")).orderBy("line_no")  # a pair, so no task gets a whole journal
    odd = F.col("line_no") % 2 == 1
    ok = F.when(odd, F.col(event) == first).otherwise((F.col(event) == second) & F.lag(F.struct(*same)).over(w).eqNullSafe(F.struct(*same)))
    return _required(df, F.coalesce(ok, F.lit(False)), "an event has no partner")


def observe_directory(spark: SparkSession, path: str, most_files: int = 10_000) -> tuple[DataFrame, dict]:
    """Lines of all journals of a directory, and what was covered: files, bytes and whether all were read."""
    names = sorted(n for n in os.listdir(path) if n.endswith(".jsonl"))
    used = names[:most_files]
    cover = {"files": len(used), "bytes": sum(os.path.getsize(f"{path}/{n}") for n in used), "complete": len(used) == len(names)}
    if not used:
        return spark.createDataFrame([], "file string, line_no int, line string"), cover
    return journal_lines(spark, [f"{path}/{n}" for n in used]), cover


def read_document(spark: SparkSession, path: str, schema: StructType, most: int) -> tuple[DataFrame, str]:
    """One strict JSON document as a one-row DataFrame, and its SHA-256: unknown and repeated keys, trailing data are refused."""
    check_local(path, most)
    with open(path, "rb") as f:
        raw = f.read()
    text = raw.decode()
    value = strict_json(text)
    _known(value, schema, "")
    return spark.createDataFrame([_row(json.loads(text), schema)], schema), hashlib.sha256(raw).hexdigest()


def _known(value: object, kind: object, at: str) -> None:
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{at or 'the document'} must be an object")
        for k in value:
            if k not in kind.names:
                raise ValueError(f"unknown field {at}{k}")
            _known(value[k], kind[k].dataType, f"{at}{k}.")
        for f in kind.fields:
            if not f.nullable and f.name not in value:
                raise ValueError(f"missing field {at}{f.name}")
    elif kind.typeName() == "array":
        for v in value if isinstance(value, list) else ():
            _known(v, kind.elementType, at)


def _row(value: object, kind: object) -> object:
    if isinstance(kind, StructType) and isinstance(value, dict):
        return tuple(_row(value.get(f.name), f.dataType) for f in kind.fields)
    if kind.typeName() == "array" and isinstance(value, list):
        return [_row(v, kind.elementType) for v in value]
    return value
