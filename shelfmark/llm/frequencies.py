"""Frequency of every distinct term, by recursive radix spilling.

Terms are cut into radix partitions by bits of their hash. The occurrences of
a term and a record are first added up by Spark (map-side), so that repeated
rows cost nothing; the sums are then shuffled by the first bits. Inside a task
the rows are written to files by the next bits; a file above ``max_bytes`` is
split again by further bits, and where a single term fills a file, by bits of
the record's hash, since distinct records of disjoint sets of records add up.
Each file is aggregated out of core by DuckDB under a memory limit. The last
step adds up the parts of each term.

Every term is spread over partitions by its records' hash from the start, over
an eighth of them all (at least ``HOT_PARTS``), so no task holds a hot term
whole, and more tasks share it the larger the cluster is. A term of few records
has no more parts than records.

Defined results: a null term counts nowhere; a null record counts in
``n_total``, not in ``n_texts``; letter case counts. ``mark`` is ``rare`` if
``n_texts`` is below ``rare_below``, else ``common`` if it is above
``common_above`` of all distinct records, else ``kept``. An empty table gives
no rows. The files lie in Spark's own local folder, as its shuffle spill does,
and are gone when the task ends; a lost task is computed again.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_dir, width

#: Least parts of one term by its records, bits taken at each level, levels by term before the record's bits are used.
HOT_PARTS, BITS, TERM_LEVELS, LEVELS = 8, 3, 5, 8
MAX_BYTES = 64 << 20
MEMORY_LIMIT = "256MB"
_PARTIAL = "field_name string, term string, n_total long, n_texts long"
_SQL = "SELECT field_name, term, CAST(sum(n) AS BIGINT) AS n_total, count(DISTINCT record) AS n_texts FROM read_parquet(?) GROUP BY ALL"


def _split(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> list[str]:
    """The rows of ``batches`` written to files of ``folder`` by the hash bits of ``level``."""
    os.makedirs(folder)
    column, shift = ("term_hash", level) if level < TERM_LEVELS else ("record_hash", level - TERM_LEVELS)
    writers: dict[int, pq.ParquetWriter] = {}
    paths: dict[int, str] = {}
    try:
        for b in batches:
            h = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False).view(np.uint64)
            part = (h >> np.uint64(8 + BITS * shift)) & np.uint64((1 << BITS) - 1)
            for p in np.unique(part).tolist():
                if p not in writers:
                    paths[p] = f"{folder}/{p}.parquet"
                    writers[p] = pq.ParquetWriter(paths[p], b.schema, compression="lz4")
                writers[p].write_batch(b.filter(pa.array(part == p)))
    finally:
        for w in writers.values():
            w.close()
    return list(paths.values())


def _aggregate(files: list[str], level: int, con: duckdb.DuckDBPyConnection, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The files' sums; a file above ``max_bytes`` is split further first."""
    for path in files:
        if os.path.getsize(path) > max_bytes and level < LEVELS:
            parts = _split(pq.ParquetFile(path).iter_batches(50_000), path + ".d", level)
            os.remove(path)
            yield from _aggregate(parts, level + 1, con, max_bytes)
        else:
            yield from con.sql(_SQL, params=[path]).to_arrow_table().to_batches(20_000)
            os.remove(path)


def radix_counts(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``field_name, term, n_total, n_texts`` of rows ``field_name, term, record``, one row of counts for each term."""
    n = width(rows.sparkSession)
    sums = rows.filter("term IS NOT NULL").groupBy("field_name", "term", "record").agg(F.count(F.lit(1)).alias("n"))
    hashed = sums.withColumns({"term_hash": F.xxhash64("field_name", "term"), "record_hash": F.xxhash64("record")})
    radix = F.pmod(F.col("term_hash"), F.lit(n * 8)).alias("radix")
    spread = hashed.repartition(n, radix, F.pmod(F.col("record_hash"), F.lit(max(HOT_PARTS, n // 8))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{scratch_dir()}/radix-{uuid.uuid4().hex}"
        os.makedirs(folder)
        con = duckdb.connect(config={"memory_limit": MEMORY_LIMIT, "threads": 1, "temp_directory": f"{folder}/tmp"})
        try:
            schema = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_total", pa.int64()), ("n_texts", pa.int64())])
            for b in _aggregate(_split(batches, f"{folder}/0", 0), 1, con, max_bytes):
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(b.columns, schema)], schema=schema)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    parts = spread.mapInArrow(run, _PARTIAL)
    return parts.groupBy("field_name", "term").agg(F.sum("n_total").alias("n_total"), F.sum("n_texts").alias("n_texts"))


def term_frequencies(rows: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.05, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``radix_counts`` with the ``mark`` of each term; ``n_records`` is the number of distinct records of the collection."""
    mark = F.when(F.col("n_texts") < rare_below, "rare").when(F.col("n_texts") > F.lit(common_above * n_records), "common").otherwise("kept")
    return radix_counts(rows, max_bytes).withColumn("mark", mark)
