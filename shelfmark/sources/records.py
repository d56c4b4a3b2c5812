"""Records of a library by relation: fixed schemas, versions and rules of its journals and documents.

A journal is a file of JSON lines in the order of its schema's fields, each written compactly, without unknown or repeated
fields; a document is one JSON object. Whatever breaks the schema, the version, the sequence or a rule fails the read: all
checks are filters, which no choice of columns prunes. Names of fields are those of the formats (fixed values).
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.codecs import ordered_json, strict_json
from shelfmark.sources.journals import _known, _required, check_pairs, check_sequence, journal_lines, read_document

def _struct(fields: str) -> str:
    """Fields ``name type, ...`` as a struct type for use inside another type."""
    return "struct<" + ",".join(f.replace(" ", ":", 1).replace(" NOT NULL", "") for f in fields.split(", ")) + ">"


_IDENTITY = "role string, id string, raw string, scheme string, origin string, confidence string, package_unique boolean"
_SOURCE = (f"kind string, path string, source_id string, source_file string, declared_url string, declared_rights array<string>, declared_licenses array<string>, "
           f"recording struct<source_format:string,position:int,tracks:int,title:string,declared_seconds:double,readers:array<struct<librivox_reader_id:string,name:string>>>, "
           f"narration struct<id:string,evidence:string,title:string>, identities array<{_struct(_IDENTITY)}>")  # fmt: skip
_MARK = "id string, asset_id string, representation string, representation_id string, unit int, offset int, cursor string, note string"
_DECLARATION = "schema string, narration_id string, recordings array<struct<source_id:string,source_format:string,kind:string,byte_identity:string>>"
_FILE = "path string, bytes long, sha256 string"


class Relation(NamedTuple):
    """Schema, versions, rules that every record keeps, most bytes of a document; journals may have a sequence and pairs of events."""

    schema: str
    rules: dict[str, str]
    versions: tuple[int, ...] = (1,)
    most: int = 0
    sequence: bool = False
    pairs: tuple[str, str, tuple[str, ...]] | None = None


_SHA = "rlike(sha256, '^[0-9a-f]{64}$')"
_LIBRARY = "rlike(library_id, '^library:[0-9a-f]{32}$')"
JOURNALS = {
    "holdings": Relation(
        f"schema_version int NOT NULL, library_id string NOT NULL, id string NOT NULL, sha256 string NOT NULL, bytes long NOT NULL, format string NOT NULL, status string NOT NULL, reason string, path string NOT NULL, "
        f"titles array<string>, languages array<string>, identities_recorded boolean, identifiers_omitted int, identities array<{_struct(_IDENTITY)}>, sources array<{_struct(_SOURCE)}>",
        {"id": "id = concat('sha256:', sha256)", "sha256": _SHA, "library": _LIBRARY, "bytes": "bytes >= 0", "status": "status IN ('checked', 'review')", "reason": "(status = 'review') = (coalesce(reason, '') != '')",
         "recordings": "forall(coalesce(sources, array()), s -> s.recording IS NULL OR (s.recording.position BETWEEN 1 AND s.recording.tracks AND s.recording.tracks <= 1000))"}),
    "operations": Relation(
        "schema_version int NOT NULL, sequence int NOT NULL, library_id string NOT NULL, operation_id string NOT NULL, event string NOT NULL, source string, asset_id string NOT NULL, format string, bytes long, status string, reason string, "
        "at string NOT NULL, import_source_sha256 string, import_holding_sha256 string",
        {"library": _LIBRARY, "asset": "rlike(asset_id, '^sha256:[0-9a-f]{64}$')", "bytes": "bytes >= 0"}, sequence=True, pairs=("intent", "completed", ("operation_id", "asset_id", "bytes"))),
    "identity": Relation("schema_version int NOT NULL, sequence int NOT NULL, library_id string NOT NULL, operation_id string NOT NULL, event string NOT NULL, at string NOT NULL",
                         {"library": _LIBRARY, "two": "sequence <= 2"}, sequence=True, pairs=("intent", "completed", ("operation_id", "library_id"))),
    "marks": Relation(
        "schema_version int NOT NULL, sequence int NOT NULL, library_id string NOT NULL, event string NOT NULL, id string, asset_id string, representation string, representation_id string, unit int, offset int, cursor string, note string, at string NOT NULL",
        {"library": _LIBRARY, "event": "event IN ('enabled', 'disabled', 'save', 'note', 'delete')", "bare": "(event IN ('enabled', 'disabled')) = (coalesce(asset_id, '') = '')", "place": "coalesce(unit, 0) >= 0 AND coalesce(offset, 0) >= 0"}, sequence=True),
    "declarations": Relation(f"schema_version int NOT NULL, sequence int NOT NULL, library_id string NOT NULL, event string NOT NULL, id string NOT NULL, declaration {_struct(_DECLARATION)}, at string NOT NULL",
                             {"library": _LIBRARY, "event": "event IN ('declared', 'retracted')", "content": "(event = 'declared') = (declaration IS NOT NULL)"}, sequence=True),
    "cleanups": Relation("schema_version int NOT NULL, sequence int NOT NULL, library_id string NOT NULL, cleanup_id string NOT NULL, event string NOT NULL, folder string, plan_digest string, manifest_sha256 string, index int, outcome string, count int, at string NOT NULL",
                         {"library": _LIBRARY, "manifest": "event NOT LIKE '%_started' OR rlike(manifest_sha256, '^[0-9a-f]{64}$')", "index": "coalesce(index, 0) >= 0"}, sequence=True),
}
DOCUMENTS = {
    "snapshot": Relation(f"schema_version int NOT NULL, id string NOT NULL, created_at string, root_hint string, complete boolean NOT NULL, assets array<struct<id:string,sha256:string,bytes:bigint,locations:array<struct<path:string,candidate_kind:string>>>> NOT NULL, excluded array<{_struct('path string, kind string, bytes long, sha256 string, finding string')}>",
                         {"ids": "forall(assets, a -> a.id = concat('sha256:', a.sha256) AND size(a.locations) > 0)", "once": "size(assets) = size(array_distinct(transform(assets, a -> a.id)))"}, most=16 << 20),
    "collection": Relation("schema_version int NOT NULL, name string NOT NULL, items array<struct<source:string,file:string,recording:string,note:string>> NOT NULL",
                           {"size": "size(items) BETWEEN 1 AND 1000", "one": "forall(items, i -> (coalesce(i.file, '') = '') != (coalesce(i.recording, '') = ''))", "once": "size(items) = size(array_distinct(transform(items, i -> struct(i.source, i.file, i.recording))))"}, most=1 << 20),
    "manifest": Relation("schema_version int NOT NULL, title string NOT NULL, resources array<struct<id:string,title:string,authors:array<string>,languages:array<string>,type:string,rationale:string,landing_url:string,metadata_url:string,rights:string,rights_url:string,review_status:string,notes:string,assets:array<struct<name:string,url:string,format:string,title:string,contributors:array<string>>>>> NOT NULL",
                         {"size": "size(resources) BETWEEN 1 AND 1000", "ids": "size(resources) = size(array_distinct(transform(resources, r -> r.id)))"}, most=2 << 20),
    "cleanup_manifest": Relation(f"schema_version int NOT NULL, cleanup_id string NOT NULL, library_id string NOT NULL, folder string, plan_digest string NOT NULL, entries array<struct<path:string,kind:string,disposition:string,reason:string,files:array<{_struct(_FILE)}>,holdings:array<string>,archive_proof:string,outcome:string>> NOT NULL",
                                 {"disposition": "forall(entries, e -> e.disposition IN ('move', 'keep'))"}, most=64 << 20),
    "purge_manifest": Relation(f"schema_version int NOT NULL, cleanup_id string NOT NULL, library_id string NOT NULL, plan_digest string NOT NULL, files array<{_struct(_FILE)}> NOT NULL, archive_groups array<struct<path:string,members:array<string>>>",
                               {"groups": "schema_version = 2 OR archive_groups IS NULL"}, versions=(1, 2), most=64 << 20),
    "receipt": Relation("schema_version int NOT NULL, complete boolean NOT NULL, status string NOT NULL, final_url string, antivirus string, transfer struct<sha256:string,bytes:bigint>, intent struct<request:struct<source_id:string,source_file:string>,selection:struct<rights_statements:array<string>,declared_license_urls:array<string>>>",
                        {"transfer": "NOT complete OR (transfer.bytes >= 0 AND rlike(transfer.sha256, '^[0-9a-f]{64}$'))"}, most=1 << 20),
    "mark_export": Relation(f"schema_version int NOT NULL, kind string NOT NULL, library_id string NOT NULL, bookmarks array<{_struct(_MARK)}> NOT NULL",
                            {"kind": "kind = 'bookmarks'", "once": "size(bookmarks) = size(array_distinct(transform(bookmarks, b -> b.asset_id)))"}, most=16 << 20),
    "declaration": Relation(_DECLARATION.replace("schema string", "schema string NOT NULL").replace("narration_id string", "narration_id string NOT NULL"),
                            {"size": "size(recordings) BETWEEN 2 AND 1000", "once": "size(recordings) = size(array_distinct(transform(recordings, r -> struct(r.source_id, r.source_format, r.kind))))"}, versions=(), most=1 << 20),
}


def _fits(schema: T.StructType):
    """Column function: whether a line is the compact encoding of a record of the schema, its fields in the schema's order."""

    def one(line: str) -> bool:
        try:
            value = strict_json(line)
            _known(value, schema, "")
            return line in ordered_json(value, schema)
        except (ValueError, RecursionError):
            return False

    @F.pandas_udf(T.BooleanType())
    def fits(x: pd.Series) -> pd.Series:
        return x.map(one, na_action="ignore")

    return fits


def _once(value: Column, name: str) -> Column:
    """The value under a name; unlike an alias it is computed once a row, not in each filter above that needs it."""
    return F.explode(F.array(value)).alias(name)


def _plain(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` with ``_read``, what Spark reads in ``line``, and ``_plain``: whether it writes the same line for it, which then ``_fits``.

    False says nothing: nulls and escapes other than those of ``< > &`` are left to ``_fits``.
    """
    lines = lines.select("*", _once(F.from_json("line", schema, {"mode": "PERMISSIVE"}), "_read"))
    lines = lines.select("*", _once(F.to_json("_read", {"ignoreNullFields": "true"}), "_text"))
    escaped = F.col("_text")
    for c in "<>&":
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    plain = ((F.col("line") == F.col("_text")) | (F.col("line") == escaped)) & ~F.contains("_text", F.lit("\\")) & ~F.contains("_text", F.lit("null"))
    for f in schema:
        if not f.nullable:
            plain &= F.col("_read")[f.name].isNotNull()
    return lines.select("*", _once(F.coalesce(plain, F.lit(False)), "_plain")).drop("_text")


def _parsed(lines: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Lines with their records ``r``, failing on a line that is not the compact encoding of a record of the schema. Python sees only lines that are not plain."""
    fits = F.col("_plain") | _fits(schema)(F.when(~F.col("_plain"), F.col("line")))
    lines = _required(_plain(lines, schema), fits, F.concat(F.lit(f"no line of {name}: "), F.col("line_no").cast("string")))
    return lines.select("file", "line_no", _once(F.when(F.col("_plain"), F.col("_read")).otherwise(F.from_json("line", schema, {"mode": "FAILFAST"})), "r"))


def _checked(df: DataFrame, relation: Relation) -> DataFrame:
    """``df``, failing on a record of another version or one that breaks a rule; the message names the rule."""
    if relation.versions:
        df = _required(df, F.col("schema_version").isin(*relation.versions), "unknown schema_version")
    for name, rule in relation.rules.items():
        df = _required(df, F.coalesce(F.expr(rule), F.lit(False)), f"a record breaks the rule {name}")
    return df


def read_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Records of a journal relation with ``file`` and ``line_no``; a torn last line was never committed and is left out."""
    relation = JOURNALS[name]
    schema = T.StructType.fromDDL(relation.schema)
    df = _parsed(journal_lines(spark, path), schema, name).filter("r IS NOT NULL").select("file", "line_no", "r.*")
    if relation.sequence:
        df = check_sequence(df, "sequence")
    df = _checked(df, relation)
    if relation.pairs:
        df = check_pairs(df, "event", relation.pairs[0], relation.pairs[1], list(relation.pairs[2]))
    return df


def create_library(folder: str, library_id: str, operation_id: str, at: str) -> None:
    """The identity journal of a new library: its intent and its completion, published once and never over another one."""
    from shelfmark.sources.sinks import publish_file

    one = '{{"schema_version":1,"sequence":{},"library_id":"{}","operation_id":"{}","event":"{}","at":"{}"}}\n'
    publish_file("".join(one.format(n, library_id, operation_id, e, at) for n, e in ((1, "intent"), (2, "completed"))), f"{folder}/identity.jsonl")


def library_status(spark: SparkSession, folder: str) -> tuple[str, str | None]:
    """Status and id of the library in a folder: not_initialized, initialized, or review where its identity cannot be relied on."""
    import os

    path = f"{folder}/identity.jsonl"
    if not os.path.exists(path):
        return "not_initialized", None
    try:
        rows = read_relation(spark, path, "identity").select("library_id").collect()  # two records at most
    except Exception:  # whatever breaks the relation's rules
        return "review", None
    return ("initialized", rows[0].library_id) if len(rows) == 2 else ("review", None)


def read_named_document(spark: SparkSession, path: str, name: str, sha256: str | None = None) -> DataFrame:
    """A document relation as one row; with ``sha256`` only the bytes that something else is bound to are accepted."""
    relation = DOCUMENTS[name]
    df, digest = read_document(spark, path, T.StructType.fromDDL(relation.schema), relation.most)
    if sha256 is not None and digest != sha256:
        raise ValueError(f"the document is not the one of SHA-256 {sha256}")
    checked = _checked(df, relation)
    return spark.createDataFrame(checked.collect(), df.schema)  # one row: a broken rule fails here
