import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, structure
from shelfmark.sources import providers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entry_ranges(spark):
    # 1 > (2 > 3), 4; 5 unresolved; 6 before 4
    e = spark.createDataFrame([("d", 1, 0, 0, 0), ("d", 2, 1, 0, 10), ("d", 3, 2, 0, 20), ("d", 4, 0, 1, 0), ("d", 5, 0, None, None), ("d", 6, 0, 2, 5), ("d", 7, 0, 2, 5), ("e", 1, 0, 0, 0)],
                              "doc string, n int, parent int, unit int, offset int")
    r = structure.entry_ranges(e, "doc", "n", "parent", ["unit", "offset"], F.col("unit").isNotNull())
    got = {(x.doc, x.n): (x.status, tuple(x.end) if x.end else None) for x in r.collect()}
    assert got == {("d", 1): ("bounded", (1, 0)), ("d", 2): ("bounded", (1, 0)), ("d", 3): ("bounded", (1, 0)), ("d", 4): ("unresolved", None), ("d", 5): ("unresolved", None),
                   ("d", 6): ("not_after_start", None), ("d", 7): ("end_of_source", None), ("e", 1): ("end_of_source", None)}


def test_links_and_cycles(spark):
    links = spark.createDataFrame([("d", 1, "a", ""), ("d", 2, "a", "x"), ("d", 3, "a", "no"), ("d", 4, "gone", ""), ("d", 5, "a", "twice")], "doc string, i int, member string, fragment string")
    members = spark.createDataFrame([("d", "a", 7)], "doc string, member string, unit int")
    targets = spark.createDataFrame([("d", 7, "x", 30), ("d", 7, "twice", 1), ("d", 7, "twice", 2)], "doc string, unit int, fragment string, offset int")
    got = {r.i: (r.status, r.offset) for r in structure.resolve_links(links, members, targets, "doc").collect()}
    assert got == {1: ("resolved", 0), 2: ("resolved", 30), 3: ("missing_fragment", None), 4: ("missing_member", None), 5: ("ambiguous_fragment", None)}
    e = spark.createDataFrame([("d", 1, 2), ("d", 2, 3), ("d", 3, 1), ("d", 3, 4), ("d", 4, 5), ("d", 5, 5), ("d", 0, 1), ("e", 1, 2)], "doc string, a int, b int")
    assert rows(structure.on_cycle(e, "doc", "a", "b")) == [("d", 1), ("d", 2), ("d", 3), ("d", 5)]


def test_deep_chains_and_long_cycles(spark):
    chain = spark.createDataFrame([("d", k, k - 1, k) for k in range(1, 101)] + [("d", 101, 0, 101)], "doc string, n int, parent int, place int")
    assert rows(structure.ancestors(chain, "doc", "n", "parent")) == [("d", n, a, n - a) for n in range(1, 101) for a in range(1, n)]
    ends = structure.entry_ranges(chain, "doc", "n", "parent", ["place"], F.lit(True)).collect()
    assert all(r.status == "bounded" and r.end.place == 101 for r in ends if r.n <= 100)
    ring = spark.createDataFrame([("d", k, k % 80 + 1) for k in range(1, 81)] + [("d", 80, 90), ("d", 90, 91), ("d", 70, 99), ("d", 99, 71)], "doc string, a int, b int")
    assert rows(structure.on_cycle(ring, "doc", "a", "b")) == [("d", k) for k in [*range(1, 81), 99]]
    loop = spark.createDataFrame([("d", 1, 2), ("d", 2, 1), ("d", 3, 1)], "doc string, n int, parent int")
    assert rows(structure.ancestors(loop, "doc", "n", "parent")) == [("d", 1, 2, 1), ("d", 2, 1, 1), ("d", 3, 1, 1), ("d", 3, 2, 2)]


def test_ranges_and_labels(spark):
    f = spark.createDataFrame([("a", k, 4) for k in range(5)] + [("a", 5, 99), ("a", 6, 1), ("b", 0, 3)], "k string, n int, size int")
    assert rows(structure.greedy_ranges(f, "k", "n", "size", 10)) == [("a", 1, 0, 1, 8), ("a", 2, 2, 3, 8), ("a", 3, 4, 4, 4), ("a", 4, 5, 5, 99), ("a", 5, 6, 6, 1), ("b", 1, 0, 0, 3)]
    pages = spark.createDataFrame([("d", k) for k in range(6)], "doc string, page int")
    ranges = spark.createDataFrame([("d", 1, "roman", "", 1), ("d", 3, "decimal", "A-", 8), ("d", 5, "none", "Cover", 1)], "doc string, first int, style string, prefix string, number int")
    assert rows(structure.page_labels(pages, ranges, "doc", "page")) == [("d", 0, ""), ("d", 1, "i"), ("d", 2, "ii"), ("d", 3, "A-8"), ("d", 4, "A-9"), ("d", 5, "Cover")]
    p = spark.createDataFrame([("d", 0, 10), ("d", 10, 20), ("d", 25, 30), ("d", 29, 40)], "doc string, start int, end int")
    assert rows(structure.parts_in_range(p, "doc", 5, 20).select("from_at", "to_at", "whole")) == [(5, 10, False), (10, 20, True)]
    assert [r.status for r in structure.checked_append(p, "doc", "start", "end").orderBy("start").collect()] == ["ok", "ok", "skip", "repeat"]


def test_changes(spark):
    files = spark.createDataFrame([(1, bytearray(b"%PDF-1.4 x"), 10, None, "pdf"), (2, bytearray(b""), 0, None, "pdf"), (3, bytearray(b"%PDF-1.4 x"), 9, None, "zip"), (4, None, 1, None, "pdf")],
                                  "k int, content binary, n long, sha string, fmt string")
    a = {r.k: (r.status, r.findings) for r in changes.assess(files, "n", "sha", "fmt").collect()}
    assert a[1] == ("limited_checks_passed", []) and a[2][0] == "invalid_or_unsupported" and a[3] == ("needs_review", ["size_differs", "format_differs"]) and a[4][0] == "incomplete"
    c = changes.classify(spark.createDataFrame([("limited_checks_passed", "clean"), ("limited_checks_passed", "failed"), ("needs_review", "clean")], "c string, s string"), F.col("c"), F.col("s"))
    assert [(r.status, r.reason) for r in c.collect()] == [("checked", None), ("review", "scanner_failed"), ("review", "findings")]
    assert changes.rescan_plan(c, "c").count() == 1
    log = spark.createDataFrame([("/x/a: b.pdf: OK",), ("/x/c: Eicar-Test FOUND",), ("", ), ("/x/d: Access ERROR",)], "line string")
    assert rows(changes.scanner_statuses(log, "line").select("file", "status")) == [("/x/a: b.pdf", "clean"), ("/x/c", "found"), ("/x/d", "failed")]
    plan = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    d = changes.digest_of(plan)
    assert d == changes.digest_of(plan.orderBy(F.col("k").desc())) != changes.digest_of(plan.distinct())
    assert rows(changes.apply_events(plan.filter("k = 1"), plan, d)) == [(2, "b"), (2, "b")]
    with pytest.raises(ValueError):
        changes.apply_events(plan, plan.filter("k = 1"), d)
    held = spark.createDataFrame([("e", "h1"), ("e", "h2"), ("f", "h1")], "entry string, sha string")
    now = spark.createDataFrame([("h1", True), ("h2", True), ("h2", False)], "sha string, verified boolean")
    assert rows(changes.purge_plan(held, now, "entry", "sha")) == [("e", 2, False), ("f", 1, True)]
    m = changes.merge_sources(spark.createDataFrame([("a", None, 1)], "k string, x int, y int"), spark.createDataFrame([("a", 5, 9), ("b", 6, None)], "k string, x int, y int"), ["k"], ["x", "y"])
    assert {tuple(r) for r in m.collect()} == {("a", 5, 1), ("b", 6, None)}
    o = spark.createDataFrame([("i", 3, "pdf"), ("i", 1, "pdf"), ("i", 2, "zip")], "i string, n int, f string")
    assert rows(changes.eligible(o, "i", "n", F.col("f") == "pdf", 1).select("n")) == [(1,)]


def test_providers(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"total": 12, "results": [{"id": f"w{k}"} for k in range(5 * n, min(12, 5 * n + 5))]}))
    assert [r.id for r in providers.read_pages(spark, str(tmp_path), 5, 3, 5).orderBy("pos").collect()] == ["w3", "w4", "w5", "w6", "w7"]
    (tmp_path / "page-1.json").write_text(json.dumps({"total": 13, "results": [{"id": "w4"}]}))
    for bad in ((5, 3, 5), (0, 0, 5), (51, 0, 5)):
        with pytest.raises(Exception):  # noqa: B017
            providers.read_pages(spark, str(tmp_path), *bad).collect()
    item = json.dumps({"metadata": {"identifier": "x", "access-restricted-item": "true"}, "files": [{"name": "a.flac", "track": "3/9", "size": "10", "length": "1:05"}, {"name": "a.mp3", "original": "a.flac", "private": "false"}]})
    got = {r["name"]: r for r in providers.item_files(spark.createDataFrame([(1, item), (2, None)], "k int, t string"), "k", "t").collect()}
    assert got["a.mp3"].track == 3 and got["a.flac"].seconds == 65.0 and got["a.flac"].private == "not_declared" and got["a.mp3"].restricted == "true"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>u:1</id><title>A\n b</title><author><name>X</name></author><author><name>Y</name></author><link href="h"/></entry></feed>'
    r = providers.atom_entry(spark.createDataFrame([(1, atom)], "k int, x string"), "k", "x").first()
    assert (r.id, r.title, r.authors, r.links, r.updated) == ("u:1", "A b", ["X", "Y"], ["h"], None)
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:p="q"><p:file rdf:about="u/1.epub"><p:extent>12</p:extent></p:file><p:file rdf:about="u/2.mp3"><p:extent>x</p:extent></p:file></rdf:RDF>'
    assert rows(providers.rdf_files(spark.createDataFrame([(1, rdf)], "k int, x string"), "k", "x").select("url", "kind")) == [("u/1.epub", "ebook_candidate"), ("u/2.mp3", "audio_candidate")]
    work = json.dumps({"open_access": {"is_oa": True, "oa_status": "gold"}, "locations": [{"pdf_url": "p"}]})
    assert providers.open_locations(spark.createDataFrame([(1, work)], "k int, x string"), "k", "x").first().pdf == "p"
