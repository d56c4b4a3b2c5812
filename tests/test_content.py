"""Content, containers, folds and plans on small fixtures: brute force, stated cases and awkward input."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import codecs, identifiers, scalars
from shelfmark.operators import changes, content, folds, library, structure, text
from shelfmark.sources import containers, journals, packing, sinks
from shelfmark.streaming import folds as live


def texts(spark, *values):
    return spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "k long, text string, status string")


def test_ranges_cover_a_text_without_loss(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("ab é漢😀\n") for _ in range(n)) for n in (0, 1, 7, 40, 300)] + [None]
    df = texts(spark, *values)
    for limit in (4, 5, 9, 64):
        for k, t in enumerate(values):
            if t is None:
                continue
            at, got = 0, []
            for _ in range(12):
                r = df.filter(F.col("k") == k).select(text.read_range("text", at, limit).alias("r")).first().r
                assert r.status in ("partial_range", "complete_range") and r.start == at and r.end - at <= limit
                got.append(r.text)
                at = r.end
                if r.end_of_unit:
                    break
            raw = t.encode()
            assert "".join(got).encode() == raw[:at]
    assert df.filter("k = 5").select(text.read_range("text", 0, 4).alias("r")).first().r is None
    bad = texts(spark, "aé").select(*[text.read_range("text", n, 4).alias(f"r{n}") for n in (2, 3, 4, 9)]).first()
    assert [b.status for b in bad] == ["invalid_request", "complete_range", "invalid_request", "invalid_request"] and bad.r2.text is None
    with pytest.raises(ValueError):
        text.read_range("text", 0, 3)


def test_gaps_are_told_once(spark):
    df = spark.createDataFrame([("abcdef", [{"at": n} for n in (0, 4, 6)])], "text string, gaps array<struct<at:long>>")
    for cuts in ([0, 4], [0, 4, 6]):
        seen = [g.at for a in cuts for g in df.select(text.read_range("text", a, 4, "gaps").alias("r")).first().r.gaps]
        assert sorted(set(seen)) == [0, 4, 6] and seen.count(0) == seen.count(4) == 1


def test_layout_against_brute_force(spark):
    rng = random.Random(2)
    values = [" ".join(rng.choice(["a", "bcd", "efghij", "漢字", "é", "x" * 20, "\n"]) for _ in range(60)) for _ in range(6)] + ["", None, "\n\n", "   "]

    def brute(t, width):
        out, word = [], 0
        for line in (t or "").split("\n"):
            row = []
            for w in line.split():
                n = sum(2 if c in "漢字" else 1 for c in w)
                if row and sum(row) + len(row) + n > width:
                    out.append((word - len(row) + 1, word, sum(row) + len(row) - 1))
                    row = []
                row.append(n)
                word += 1
            if row:
                out.append((word - len(row) + 1, word, sum(row) + len(row) - 1))
        return out

    df = texts(spark, *values)
    for width in (1, 7, 30):
        got = {}
        for r in text.line_layout(df, "k", "text", width).orderBy("k", "line_no").collect():
            got.setdefault(r.k, []).append((r.first_word, r.last_word, r.n_cells))
        assert got == {k: b for k, t in enumerate(values) if (b := brute(t, width))}


def test_reading_times_and_chunks(spark):
    df = spark.createDataFrame([("plain",), ("paragraph)",), ("end.”",), ("well,",), ("dash—",), ("終。」",), ("（注）",)], "w string")
    got = [tuple(r) for r in df.select(scalars.pause_class("w"), scalars.dwell_ms("w", 250)).collect()]
    assert got == [("none", 240.0), ("none", 312.0), ("sentence", 480.0), ("clause", 360.0), ("none", 240.0), ("sentence", 480.0), ("none", 240.0)]
    one = df.limit(1).select(scalars.dwell_ms("w", 1, F.lit("gap")), scalars.dwell_ms("w", 9999, F.lit("heading")), scalars.dwell_ms("w", 250, F.lit("break")), scalars.dwell_ms("w", 250, F.lit("word"), F.lit("paragraph"))).first()
    assert tuple(one) == (1800.0, 750.0, 0.0, 600.0)
    assert codecs.grapheme_chunks("漢字ab", 3) == ["漢", "字a", "b"] and codecs.grapheme_chunks("漢", 1) == ["漢"] and codecs.grapheme_chunks("", 3) == []
    assert codecs.grapheme_chunks("é" * 5, 2) == ["éé", "éé", "é"]
    assert [codecs.focus(w) for w in ("", "a", "ab", "abcdef", "abcdefghijklmnop")] == [("", "", ""), ("", "a", ""), ("a", "b", ""), ("ab", "c", "def"), ("abcd", "e", "fghijklmnop")]


def test_identifiers(spark):
    c = spark.createDataFrame([("https://doi.org/10.1000/ABC", "url"), ("doi:10.1/x", ""), ("10.1000/x", "doi"), ("10.1000/x", ""), ("doi:10.1000/a#b", ""), ("https://openlibrary.org/works/OL12W/", ""), ("https://openlibrary.org/works/OL12M", ""),
                               ("https://openlibrary.org/books/ol7m", "URL"), ("9780306406157", "ISBN"), ("9780306406158", "ISBN"), (None, None), ("", ""), ("a\nb", "")], "raw string, scheme string")
    got = [r.i and (r.i.role, r.i.id[:24]) for r in c.select(identifiers.package_identity("raw", "scheme").alias("i")).collect()]
    u = ("unassigned", "stated:")
    assert [g if not g or g[0] != "unassigned" else (g[0], g[1][:7]) for g in got] == [
        ("publication_version", "doi:10.1000/ABC"), u, ("publication_version", "doi:10.1000/x"), u, u, ("work", "openlibrary_work:OL12W"), u, ("edition", "openlibrary_edition:OL7M"), ("edition", "isbn:9780306406157"), u, None, None, None]
    j = spark.createDataFrame([('"a"',), ("[]",), ("[1]",), ("null",), ("007",), ('"-0"',), ('" 1"',), (None,), ("9" * 30,)], "x string")
    assert [(r[0], r[1], r[2]) for r in j.select(codecs.json_text("x"), codecs.json_texts("x"), codecs.json_size("x")).collect()] == [
        ("a", ["a"], None), ("", [], None), ("", None, None), ("", [], None), ("", None, 7), ("-0", ["-0"], 0), (" 1", [" 1"], None), ("", None, None), ("", None, None)]
    assert codecs.digest_without('{"b":1,"a":2}', ("b",)) == codecs.digest_without('{"a":2}', ()) and codecs.digest_without("[1]", ()) is None


def test_page_lists_and_budgets(spark):
    one = packing.epub_of("T", "en", ["i"], [("H", "<p>x</p>")], [("iv", "c1.xhtml#p4"), ("", "http://e.example/")])
    twice = one.replace(b"page-list", b"page-list")
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(one))
    double = packing.zip_of([(n, z.read(n).replace(b"</body>", b'<nav epub:type="page-list"><ol/></nav></body>') if n.endswith("nav.xhtml") else z.read(n)) for n in z.namelist()])
    second = packing.zip_of([(n, z.read(n).replace(b'<item id="c1"', b'<item id="n2" href="nav.xhtml#2" media-type="application/xhtml+xml" properties="nav"/><item id="c1"').replace(b"nav.xhtml#2", b"nav2.xhtml") if n.endswith("p.opf") else z.read(n)) for n in z.namelist()]
                            + [("OPS/nav2.xhtml", z.read("OPS/nav.xhtml"))])
    none = packing.epub_of("T", "en", ["i"], [("H", "<p>x</p>")])
    files = spark.createDataFrame([("one", bytearray(twice)), ("double", bytearray(double)), ("second", bytearray(second)), ("none", bytearray(none)), ("bad", bytearray(b"PK")), ("null", None)], "path string, content binary").filter("content IS NOT NULL")
    got = sorted((r.path, r.ord, r.label, r.member, r.fragment, r.problem) for r in containers.epub_page_lists(files).filter("finding IS NULL").collect())
    assert got == [("double", 0, None, None, None, "multiple_page_lists"), ("one", 1, "iv", "OPS/c1.xhtml", "p4", None), ("one", 2, "", "", "", None), ("second", 0, None, None, None, "multiple_nav_documents"), ("second", 0, None, None, None, "multiple_nav_documents")]
    deep = packing.zip_of([("a.zip", packing.zip_of([("t", b"12345"), ("u", b"678")])), ("v", b"9")])
    f = spark.createDataFrame([("d", bytearray(deep))], "path string, content binary")
    size = len(packing.zip_of([("t", b"12345"), ("u", b"678")]))
    for most, want in ((size + 9, ["archive", "ok", "ok", "ok"]), (size + 5, ["archive", "ok", "over_budget", "over_budget"]), (3, ["over_budget", "ok"])):
        assert [r.disposition for r in containers.nested_members(f, most_bytes=most).orderBy("ord").collect()] == want
    assert [r.disposition for r in containers.nested_members(f, levels=1).orderBy("ord").collect()] == ["too_deep", "ok"]
    with pytest.raises(ValueError):
        content.units(f, "epub-source/1")
    with pytest.raises(ValueError):
        content.units(f, "docx/1")
    assert content.read(files.filter("path = 'one'"), "epub-source/1", 1, 0, 64).first().text.startswith("<html")


def test_images(spark):
    i = spark.createDataFrame([("d", "OPS/a.xhtml", "x.png"), ("d", "OPS/a.xhtml", "../y.png"), ("d", "OPS/a.xhtml", "http://e.example/z.png"), ("d", "OPS/a.xhtml", "../../w.png"), ("e", "OPS/a.xhtml", "x.png")], "doc string, base string, src string")
    m = spark.createDataFrame([("d", "OPS/x.png", 3, "s"), ("d", "OPS/q.png", 4, "t")], "doc string, member string, bytes int, sha256 string")
    assert [(r.status, r.image_bytes) for r in structure.resolve_images(i, m, "doc").orderBy("doc", "src").collect()] == [("invalid", None), ("missing_member", None), ("external", None), ("local_resource", 3), ("missing_member", None)]


def test_digests_in_levels(spark, monkeypatch):
    import hashlib

    h = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    rows = [("a", n, f"v{n}") for n in range(10)] + [("b", 0, "x")]
    df = spark.createDataFrame(rows, "k string, p int, v string")
    flat = {r.k: (r.digest, r.n) for r in structure.ordered_digest(df, ["k"], "p", F.col("v")).collect()}
    assert flat == {"a": (h(*[f"v{n}" for n in range(10)]), 10), "b": (h("x"), 1)}
    monkeypatch.setattr(structure, "UNITS_A_BUCKET", 3)
    deep = {r.k: (r.digest, r.n) for r in structure.ordered_digest(df.repartition(5), ["k"], "p", F.col("v")).collect()}
    leaf = [h(*[f"v{n}" for n in range(a, min(10, a + 3))]) for a in (0, 3, 6, 9)]
    assert deep == {"a": (h(h(*leaf[:3]), h(leaf[3])), 10), "b": (h("x"), 1)}
    # one position that holds more than a bucket: the same for any order of the rows, another for other rows or numbers of rows
    hot = spark.createDataFrame([("h", 1, f"v{n}") for n in range(40)] + [("h", 1, "same")] * 50 + [("c", 1, "x")], "k string, p int, v string")
    one = {r.k: (r.digest, r.n) for r in structure.ordered_digest(hot, ["k"], "p", F.col("v")).collect()}
    assert one == {r.k: (r.digest, r.n) for r in structure.ordered_digest(hot.orderBy(F.desc("v")).repartition(7), ["k"], "p", F.col("v")).collect()} and one["h"][1] == 90
    for other in (hot.filter("v != 'v3'"), hot.unionByName(hot.filter("v = 'same'").limit(1))):
        assert {r.k: r.digest for r in structure.ordered_digest(other, ["k"], "p", F.col("v")).collect()}["h"] != one["h"][0]
    assert structure.ordered_digest(hot.limit(0), ["k"], "p", F.col("v")).count() == 0
    plan = spark.createDataFrame([(n, f"p{n}" if n % 7 else None) for n in range(300)], "k int, n string")
    for size in (2_048, 20, 2):
        monkeypatch.setattr(changes, "DIGESTS_A_BUCKET", size)
        a = changes.digest_of(plan)
        assert a == changes.digest_of(plan.orderBy(F.desc("k")).repartition(3)) != changes.digest_of(plan.unionByName(plan.limit(1)))
        assert a != changes.digest_of(plan.filter("k != 3")) and a != changes.digest_of(plan.withColumn("n", F.when(F.col("k") != 5, F.col("n"))))
    assert changes.digest_of(plan.limit(0)) == hashlib.sha256(b"").hexdigest()
    assert changes.digest_of(plan.withColumnRenamed("n", "d").withColumnRenamed("k", "n")) != a


def test_checks_are_made_whatever_is_selected(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"id":"a","sequence":1}\n{"id":"b","sequence":3}\n')
    df = journals.read_journal(spark, str(path), "id string, sequence int")
    with pytest.raises(Exception):  # noqa: B017
        journals.check_sequence(df, "sequence").select("file").collect()
    with pytest.raises(Exception):  # noqa: B017
        journals.check_pairs(df.withColumn("event", F.lit("x")), "event", "x", "y", ["id"]).select("line_no").count()
    path.write_text('{"id": "a"}\n')
    with pytest.raises(Exception):  # noqa: B017
        journals.read_journal(spark, str(path), "id string").select("line_no").collect()
    path.write_text('["a"]\n')
    with pytest.raises(Exception):  # noqa: B017
        journals.read_journal(spark, str(path), "id string").select("line_no").collect()


def test_a_replayed_batch_stands_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1,), (2,)], "n int").write.parquet(str(source))
    for run in ("a", "b"):  # a lost checkpoint: the same batch is written again
        live.to_table(spark.readStream.schema("n int").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / run))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_mark_logs(spark):
    log = [("l", 1, "enabled", None, None), ("l", 2, "save", "a", "m1"), ("l", 3, "note", "a", "m1"), ("l", 4, "save", "b", "m2"), ("l", 5, "delete", "b", "m2"), ("l", 6, "disabled", None, None),
           ("w", 1, "enabled", None, None), ("w", 2, "save", "a", "m1"), ("w", 3, "note", "a", "m9"), ("x", 1, "save", "a", "m"), ("y", 1, "enabled", None, None), ("y", 2, "disabled", None, None), ("y", 3, "save", "a", "m"),
           ("z", 1, "enabled", None, None), ("z", 2, "save", "a", "m"), ("z", 3, "delete", "a", "m"), ("z", 4, "note", "a", "m"), ("q", 1, "enabled", None, None), ("v", 1, "enabled", None, None), ("v", 2, "odd", "a", "m"),
           ("s", 1, "enabled", None, None), ("s", 2, "save", "a", "m1"), ("s", 3, "note", "a", "m1"), ("s", 4, "save", "a", "m2")]
    df = spark.createDataFrame(log, "log string, line int, event string, asset string, mark string")
    got = {r.log: (r.asset, r.mark, r.saved_line, r.note_line, r.enabled, r.valid) for r in folds.mark_log_fold(df, "log", "line", "event", "asset", "mark").collect()}
    bad = (None, None, None, None, None, False)
    assert got == {"l": ("a", "m1", 2, 3, False, True), "w": bad, "x": bad, "y": bad, "z": bad, "v": bad, "q": (None, None, None, None, True, True), "s": ("a", "m2", 4, None, True, True)}
    assert folds.mark_log_fold(df.limit(0), "log", "line", "event", "asset", "mark").count() == 0


def _marks_of(events):
    """The rows of one log, read line by line."""
    on, has, notes, ok = None, {}, {}, bool(events) and events[0][1] == "enabled"
    for line, event, asset, mark in events:
        if event in ("enabled", "disabled"):
            on = event == "enabled"
        elif event == "save":
            ok &= on is True
            has[asset], notes[asset] = (mark, line), None
        elif event in ("note", "delete"):
            ok &= asset in has and has[asset][0] == mark
            if event == "note":
                notes[asset] = line
            else:
                has.pop(asset, None)
        else:
            ok = False
    if not ok:
        return {(None, None, None, None, None, False)}
    return {(a, m, n, notes[a], on, True) for a, (m, n) in has.items()} or {(None, None, None, None, on, True)}


def test_mark_logs_in_blocks(spark, monkeypatch):
    """Logs of many blocks give what reading line by line gives, and whatever makes their rows runs once for each."""
    import random

    rnd = random.Random(5)
    logs = {}
    for k in range(150):
        line, on, has, events = rnd.choice((1, 5)), True, {}, [(1, "enabled", None, None)]
        for _ in range(rnd.randrange(14)):
            line += rnd.choice((1, 1, 1, 9))
            asset = rnd.choice("ab")
            event = rnd.choice(("save", "save", "note", "delete", "disabled", "enabled"))
            if event == "save" and (on or rnd.random() < 0.1):
                has[asset] = f"m{line}"
                events.append((line, event, asset, has[asset]))
            elif event in ("note", "delete") and (asset in has or rnd.random() < 0.05):
                events.append((line, event, asset, has.get(asset, "m?")))
                if event == "delete":
                    has.pop(asset, None)
            elif event in ("enabled", "disabled"):
                on = event == "enabled"
                events.append((line, event, None, None))
        events += [(line + 1, None, "a", "m")] * (rnd.random() < 0.03)
        logs[k] = events[rnd.random() < 0.05 :]
    rows = [(k, *e) for k, events in logs.items() for e in events]
    want = {(k, *r) for k, events in logs.items() if events for r in _marks_of(events)}
    assert 20 < sum(r[-1] for r in want) and 20 < sum(not r[-1] for r in want)
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "log long, line int, event string, asset string, mark string")
    monkeypatch.setattr(folds, "BLOCK", 3)
    got = folds.mark_log_fold(df.mapInArrow(seen, df.schema), "log", "line", "event", "asset", "mark").select("log", "asset", "mark", "saved_line", "note_line", "enabled", "valid").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and made.value == len(rows)


def test_filters_and_steps(spark):
    with pytest.raises(ValueError):
        library.has_format("f", "doc")
    df = spark.createDataFrame([("epub",), (None,)], "f string")
    assert [r.f for r in df.filter(library.has_format("f", "epub")).collect()] == ["epub"] and df.filter(library.has_format("f", "all")).count() == 2
    s = spark.createDataFrame([(["/a/b"],), (["/a/b", "/c"],), ([],), (None,), (["/ab"],), (["/a"],), ([None],)], "p array<string>")
    assert [r.p for r in s.filter(library.in_scope("p", ["/a/"])).collect()] == [["/a/b"], ["/a"]]
    e = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "k int, sel string")
    p = spark.createDataFrame([(2, "y"), (3, "q"), (4, None)], "k int, sel string")
    got = {r.k: r.action for r in library.acquire_steps(e, e.filter("k = 9"), p, ["k"], "sel").collect()}
    assert got == {1: "fetch", 2: "import", 3: "conflict", 4: "conflict"}


def test_store_and_escapes(spark, tmp_path):
    df = spark.createDataFrame([("a\u200bb\x07\u2028\U000e0001",)], "t string").select(sinks.escaped_json("t").alias("line"))
    line = df.first().line
    assert not any(unicodedata.category(c) in ("Cc", "Cf") for c in line)
    assert df.select(F.from_json("line", "t string").t).first()[0] == "a\u200bb\x07\u2028\U000e0001"
    files = spark.createDataFrame([(bytearray(b"1"),)], "content binary")
    root = f"file://{tmp_path}/store"
    assert sinks.store_by_content(files, root).count() == sinks.store_by_content(files, root).count() == 1
    assert spark.read.parquet(root).count() == 1


SIMPLE = b"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R/OpenAction 9 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R 2 0 R]/Count 1>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/Resources<</Font<</F1 4 0 R>>/XObject<</X 6 0 R>>>>/Contents [5 0 R 7 0 R]>> endobj
4 0 obj <</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/fi/eacute/zzz 65/B]>>>> endobj
5 0 obj <</Length 300>>stream
BT /F1 12 Tf 1 0 0 1 72 700 Tm (A\\(x\\)\\001\\002\\003 (in) ) Tj [(Wo)-20(rd)-300(gap)] TJ T* (next) ' ET /X Do
BI /W 1 /H 1 ID x EI BT (after) Tj ET
endstream endobj
6 0 obj <</Subtype/Form/Resources<</Font<</F1 4 0 R>>>>/Length 40>>stream
BT /F1 9 Tf (form) Tj ET /X Do
endstream endobj
7 0 obj <</Length 4/Filter/DCTDecode>>stream
jpeg
endstream endobj
trailer <</Root 1 0 R>>"""


def test_pdf_pages(spark):
    import zlib

    from shelfmark.sources import pdf

    first = b"<</Type/Catalog/Pages 2 0 R/PageLabels<</Nums[0<</P(x)>>]>>>> "
    objects = first + b"<</Type/Pages/Kids[3 0 R]/Count 1>>"
    head = f"1 0 2 {len(first)} ".encode()
    z = zlib.compress(head + objects)
    compact = (b"%PDF-1.5\n3 0 obj <</Type/Page/Contents 5 0 R>> endobj 5 0 obj <</Length 0>>stream\n\nendstream endobj\n" + f"9 0 obj <</Type/ObjStm/N 2/First {len(head)}/Length {len(z)}/Filter/FlateDecode>>stream\n".encode() + z
               + b"\nendstream endobj\n10 0 obj <</Type/XRef/Root 1 0 R/Length 0>>stream\n\nendstream endobj")
    files = [("simple", SIMPLE), ("compact", compact), ("locked", SIMPLE.replace(b"trailer <<", b"trailer <</Encrypt 8 0 R")), ("cut", SIMPLE[:150]), ("no", b"text"), ("empty", b"")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary")
    rows = {r.path: r for r in pdf.pdf_pages(df).collect()}
    simple = rows["simple"]
    assert simple.text == "B(x)fié (in) Word gap\nnext\nform\nafter" and simple.n_images == 1 and simple.label is None
    assert [(g.kind, g.detail) for g in simple.gaps] == [("unmapped_code", None), ("image", "inline"), ("unreadable_stream", "filter DCTDecode")]
    assert rows["compact"].label == "x" and [g.kind for g in rows["compact"].gaps] == ["no_text_layer"]
    assert all(rows[n].finding for n in ("locked", "no", "empty")) and rows["simple"].finding is None
    assert {r.path: (r.version, r.pages, r.active) for r in pdf.pdf_facts(df).filter("finding IS NULL").collect()}["simple"] == ("1.4", 1, ["open_action"])
    assert [pdf.glyph(n) for n in ("eacute", "Scaron", "ccedilla", "uni4E00", "u1F600", "a", "zzz", "fl.alt")] == ["é", "Š", "ç", "一", "😀", "a", None, "fl"]
    rowsize = 3
    raw = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 1, 1, 1, 4, 1, 1, 1])
    assert pdf._unpredict(raw, {"Columns": rowsize}) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])


def test_audio_layers_and_info(spark):
    layer1 = bytes([0xFF, 0xFF, 0x50, 0]) + b"\0" * (12 * 160000 // 44100 * 4 - 4)
    layer2 = bytes([0xFF, 0xFD, 0x50, 0]) + b"\0" * (144 * 80000 // 44100 - 4)
    info = bytes([0xFF, 0xFB, 0x90, 0]) + (b"\0" * 32 + b"Info").ljust(413, b"\0")
    files = spark.createDataFrame([("1", bytearray(layer1 * 3)), ("2", bytearray(layer2 * 3)), ("3", bytearray(info + packing.mp3_of(2)))], "path string, content binary")
    got = {}
    for r in containers.mp3_frames(files).orderBy("path", "at").collect():
        got.setdefault(r.path, []).append((r.kind, r.samples))
    assert got == {"1": [("frame", 384)] * 3, "2": [("frame", 1152)] * 3, "3": [("info", None), ("frame", 1152), ("frame", 1152)]}
    bad = packing.mp3_of(2, tag=packing.id3_chapters([("c", 0, 1, "t")])[:-1])
    assert containers.mp3_chapters(spark.createDataFrame([("x", bytearray(bad)), ("y", bytearray(b"abcd"))], "path string, content binary")).select("path", F.col("finding").isNotNull().alias("f")).collect() == [("x", True)]


def test_text_units_open_each_asset_once(spark):
    """Units are those of the representation that reads each asset; one pass, no join, no second reading."""
    from shelfmark.operators import content
    from shelfmark.sources import packing

    book = packing.epub_of("t", "en", ["i"], [("A", "<h1>One</h1><p>caf\u00e9</p>"), ("B", "<p>x</p><img src='a.png'/>")])
    paper = packing.pdf_of(["one\ntwo", ""], [(0, "r", "", 3)], 0)
    empty = packing.epub_of("t", "en", ["i"], [])
    files = spark.createDataFrame([("book", book), ("paper", paper), ("none", b"no book"), ("empty", empty), ("cut", book[:200])], "path string, content binary")
    u = content.text_units(files)
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "Exchange" not in plan
    got = {(r.path, r.unit): r for r in u.collect()}
    assert set(got) == {("book", 1), ("book", 2), ("paper", 1), ("paper", 2), ("none", None), ("empty", None), ("cut", None)}
    for rep, path in (("epub-text/2", "book"), ("pdf-text/1", "paper")):
        for w in content.units(files.filter(files.path == path), rep).collect():
            r = got[path, w.unit]
            assert r.representation == rep and all(r[c] == w[c] for c in w.asDict())
    for path in ("none", "empty", "cut"):
        w = content.units(files.filter(files.path == path), "pdf-text/1").first()
        r = got[path, None]
        assert r.finding == w.finding and r.finding and r.representation is None and r.status is None and r.bytes is None


def test_text_units_of_damaged_assets_do_not_fail_the_others(spark):
    """Whatever a file holds, it has its rows and the others theirs; all is read in one step outside the JVM."""
    import re

    book = packing.epub_of("t", "en", ["i"], [("A", "<p>x</p>")])
    paper = packing.pdf_of(["one\ntwo"], [(0, "r", "", 3)])
    maps = re.compile(rb"stream\n.{6}", re.S).sub(b"stream\nx\x9c\xff\xff\xff\xff", paper, count=1)  # the font's map cannot be unpacked
    rootless = packing.zip_of([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", b"<container/>")])
    files = spark.createDataFrame([("book", book), ("paper", paper), ("maps", maps), ("rootless", rootless), ("null", None), ("", b"")], "path string, content binary")
    u = content.text_units(files)
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "MapInArrow" not in plan
    got = {r.path: r for r in u.collect()}
    assert len(got) == u.count() == 6
    assert (got["book"].status, got["book"].bytes, got["book"].n_chars) == ("text", 1, 1) and (got["paper"].status, got["paper"].bytes, got["paper"].label) == ("text", 7, "iii")
    assert (got["maps"].representation, got["maps"].unit, got["maps"].status, got["maps"].bytes) == ("pdf-text/1", 1, "text_with_gaps", 0)
    assert all(got[k].finding and got[k].unit is None and got[k].representation is None for k in ("rootless", "null", ""))


def test_pdf_lines_read_at_once_are_the_tokens_one_by_one(spark):
    """Lines and pairs of character maps are read in one step where they stand alone, with the same text as any other spelling."""
    from shelfmark.sources import pdf

    def page(shown: bytes, pairs: bytes) -> tuple:
        cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 3 beginbfchar " + pairs + b" endbfchar"
        put = lambda b: b"<</Length %d>>stream\n%s\nendstream endobj " % (len(b), b)
        return next(pdf.read_pages(b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Resources<</Font<</F 5 0 R>>>>>> endobj 3 0 obj <</Contents 4 0 R>> endobj "
                                   b"5 0 obj <</Subtype/Type1/ToUnicode 6 0 R>> endobj 4 0 obj " + put(b"BT /F 9 Tf " + shown + b" ET") + b"6 0 obj " + put(cmap) + b"trailer<</Root 1 0 R>>"))  # fmt: skip

    pairs = b"<41> <0061> <42><00e90062> <43> <D83DDE00>"
    plain = page(b"<4142> Tj 0 -14 Td <43> Tj 5 0 Td <41> Tj 0 +1 TD <81> Tj 0 -1 Td <4> Tj", pairs)
    other = page(b"<41 42> Tj 0 % here\n-14 Td [<43>] TJ 5. 0 Td (A) Tj 0 1.0 TD (\\201) Tj 0 -1 Td <40>Tj", pairs.replace(b" <43>", b" %x\n<4 3>"))
    assert plain[2] == "a\u00e9b\n\U0001f600 a\n@"
    assert plain == other and [g["kind"] for g in plain[4]] == ["unmapped_code"]
