"""Writers: snapshots that never overwrite, canonical journals, a content-addressed store, exports."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.codecs import visible_escapes_udf
from shelfmark.functions.scalars import col


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A new table at ``path``; an existing one is never overwritten."""
    df.write.mode("error").format(fmt).save(path)


def publish_file(text: str, path: str) -> None:
    """One small file, complete or not there at all, never over another one."""
    folder = os.path.dirname(path)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(f.name, path)
    finally:
        os.unlink(f.name)


def export_document(rows: DataFrame, path: str, head: dict[str, object], field: str, order: list[str], most: int = 16 << 20) -> str:
    """A document of ``head`` and the rows as its list ``field``, published once and never over another one; its SHA-256.

    The list is read in order, row by row, and refused as soon as it passes ``most`` bytes, so the driver never holds more.
    """
    items, size = [], 0
    for r in rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
        size += len(r.j.encode()) + 1
        if size > most:
            raise ValueError(f"the document is above {most} bytes")
        items.append(r.j)
    start = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1]
    text = f"{start}{',' if head else ''}{json.dumps(field)}:[{','.join(items)}]}}"
    publish_file(text, path)
    return hashlib.sha256(text.encode()).hexdigest()


def copy_verified(source: str, path: str, sha256: str) -> None:
    """A copy of one file that has the stated digest, complete or not there at all, never over another one."""
    seen = hashlib.sha256()
    with tempfile.NamedTemporaryFile("wb", dir=os.path.dirname(path), delete=False) as out, open(source, "rb") as f:
        while block := f.read(1 << 20):
            seen.update(block)
            out.write(block)
        out.flush()
        os.fsync(out.fileno())
    try:
        if seen.hexdigest() != sha256:
            raise ValueError("the bytes are not those of the stated digest")
        os.link(out.name, path)
    finally:
        os.unlink(out.name)


def escaped_json(*cols: str) -> Column:
    """A row as JSON in which control and format characters are escapes, so that it reads back the same; nulls kept out."""
    return visible_escapes_udf(F.to_json(F.struct(*cols)))


def append_lines(df: DataFrame, path: str, *cols: str, most: int = 1 << 20) -> None:
    """Records appended as JSON lines; a record above ``most`` bytes is refused."""
    line = escaped_json(*(cols or df.columns))
    ok = F.when(F.octet_length(line) <= most, line).otherwise(F.raise_error(F.lit("record too long")))
    df.select(ok.alias("value")).write.mode("append").text(path)


def store_by_content(files: DataFrame, root: str) -> DataFrame:
    """Contents in ``root`` under the first digits of their SHA-256; equal contents once. Gives what is stored now."""
    d = files.select(F.sha2("content", 256).alias("sha256"), "content")
    once = d.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("prefix", F.substring("sha256", 1, 2))
    spark = files.sparkSession
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/prefix=*")
    if pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern):  # any file system that Spark reads
        once = once.join(spark.read.parquet(root).select("sha256"), "sha256", "left_anti")
    once.write.mode("append").partitionBy("prefix").parquet(root)
    return spark.read.parquet(root).select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("verified"))


def reading_list_line(title: Column | str, authors: Column | str, url: Column | str) -> Column:
    """A line of a Markdown list: the title as a link, then the authors."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\`*_\[\]<>])", r"\\$1")
    names = F.when(F.size(col(authors)) > 0, F.concat(F.lit(" — "), safe(F.array_join(col(authors), "; ")))).otherwise("")
    return F.concat(F.lit("- ["), safe(col(title)), F.lit("]("), F.coalesce(col(url), F.lit("")), F.lit(")"), names)


def reading_list(df: DataFrame, title: str, authors: str, url: str) -> DataFrame:
    """Lines of a Markdown list."""
    return df.select(reading_list_line(title, authors, url).alias("line"))


def wav(pcm: Column, rate: int, channels: int, bits: int = 16) -> Column:
    """A WAV file around little-endian PCM bytes."""
    size = F.octet_length(pcm)
    le = lambda c, n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)]))
    fixed = lambda b: F.lit(bytearray(b))
    head = (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + channels.to_bytes(2, "little") + rate.to_bytes(4, "little")
    head += (rate * channels * bits // 8).to_bytes(4, "little") + (channels * bits // 8).to_bytes(2, "little") + bits.to_bytes(2, "little")
    return F.concat(fixed(b"RIFF"), le(size + 36, 4), fixed(b"WAVEfmt "), fixed(head), fixed(b"data"), le(size, 4), pcm)
