"""File inventories as a Python data source: entries below a root, links never followed, limits enforced."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.scalars import file_kind

SCHEMA = "path string, bytes long, sha256 string, finding string"


class _Slice(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.depth, self.entries = int(options.get("depth", 32)), int(options.get("entries", 1_000_000))
        self.most, self.hash = int(options.get("mostBytes", 1 << 40)), options.get("hash", "true") == "true"
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[_Slice]:
        found, stack = [], [("", 0)]
        while stack:
            rel, depth = stack.pop()
            if depth > self.depth:
                raise ValueError(f"deeper than {self.depth} levels: {rel}")
            for e in os.scandir(os.path.join(self.root, rel)):
                name = f"{rel}/{e.name}" if rel else e.name
                if e.is_dir(follow_symlinks=False):
                    stack.append((name, depth + 1))
                else:
                    found.append(name)
                if len(found) > self.entries:
                    raise ValueError(f"more than {self.entries} entries")
        found.sort()
        return [_Slice(found[k :: self.parts]) for k in range(min(self.parts, len(found)) or 1)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for rel in partition.paths:
            path = os.path.join(self.root, rel)
            s = os.lstat(path)
            if not stat.S_ISREG(s.st_mode):
                yield rel, None, None, "not_a_regular_file"
            elif s.st_size > self.most:
                yield rel, s.st_size, None, "too_large"
            elif not self.hash:
                yield rel, s.st_size, None, None
            else:
                h = hashlib.sha256()
                with open(path, "rb") as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                yield rel, s.st_size, h.hexdigest(), None


class InventorySource(DataSource):
    """``spark.read.format("shelfmark_inventory").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "shelfmark_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def inventory(spark: SparkSession, root: str, **limits: object) -> DataFrame:
    """Entries below ``root`` with kind, size, digest and finding."""
    spark.dataSource.register(InventorySource)
    r = spark.read.format("shelfmark_inventory")
    for k, v in limits.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return r.load(root).withColumn("kind", file_kind(F.col("path")))
