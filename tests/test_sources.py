import io
import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.sources import catalog_csv, containers, inventory, journals, sinks

HEAD = "Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n"
ROW = '12,Text,1998-01-01,"A title\nover lines, ""quoted""",en; fr,"Austen, Jane, 1775-1817; Other, A",England -- Fiction,PR,Best; \n'


def write(path, data):
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_catalog(spark, tmp_path):
    df = catalog_csv.read_catalog(spark, write(tmp_path / "c.csv", HEAD + ROW + "7,Sound,,Short,de,,,,\n"))
    r = {x.num: x for x in df.collect()}
    assert r[12].title == 'A title over lines, "quoted"' and r[12].languages == ["en", "fr"] and r[12].authors == ["Austen, Jane, 1775-1817", "Other, A"]
    assert r[7].authors == [] and len(r[7].row_sha256) == 64
    for bad in (HEAD.replace("LoCC", "Locc") + ROW, HEAD + "12,Text,1998\n", HEAD + ROW.replace("12,", "x12,"), HEAD + ROW.replace("1998-01-01", "1998"), HEAD + ROW + ROW):
        with pytest.raises(Exception):  # noqa: B017
            catalog_csv.read_catalog(spark, write(tmp_path / "bad.csv", bad)).collect()
    with pytest.raises(ValueError):
        catalog_csv.check_local("relative.csv")


def test_journal(spark, tmp_path):
    lines = ['{"at":"t1","event":"intent","id":"a","sequence":1}', '{"at":"t2","event":"completed","id":"a","sequence":2}']
    path = write(tmp_path / "j.jsonl", "\n".join(lines) + '\n{"torn')
    schema = "at string, event string, id string, sequence int"
    df = journals.check_pairs(journals.check_sequence(journals.read_journal(spark, path, schema), "sequence"), "event", "intent", "completed", ["id"])
    assert [(r.line_no, r.event) for r in df.orderBy("line_no").collect()] == [(1, "intent"), (2, "completed")]
    for bad in ('{"event": "intent"}\n', lines[1] + "\n", lines[0] + "\n" + lines[1].replace('"a"', '"b"') + "\n"):
        with pytest.raises(Exception):  # noqa: B017
            d = journals.read_journal(spark, write(tmp_path / "b.jsonl", bad), schema)
            journals.check_pairs(journals.check_sequence(d, "sequence"), "event", "intent", "completed", ["id"]).collect()
    os.remove(tmp_path / "b.jsonl")
    df, cover = journals.observe_directory(spark, str(tmp_path), 1)
    assert cover == {"files": 1, "bytes": os.path.getsize(path), "complete": True} and df.count() == 2


def test_journal_lines_in_blocks(spark, tmp_path):
    """Numbers, torn ends and bytes of journals that are read in many blocks are those of whole files; no plan reads a whole file."""
    import random

    rnd = random.Random(3)
    folder = tmp_path / "a é=+%41 b"
    folder.mkdir()
    text = lambda n: "\n".join("".join(rnd.choice("aé\r\u2028 x") for _ in range(rnd.choice((0, 1, 7, 90)))) for _ in range(n))
    files = {"long.jsonl": text(30) + "\n", "torn.jsonl": text(30) + "\nx", "only torn": "x", "empty": "", "feed": "\n", "feeds": "\n\na\n\n", "mark": "\ufeffa\nb\n", "torn mark": "\ufeffa\nb", "mark alone": "\ufeff"}
    for n, t in files.items():
        (folder / n).write_bytes(t.encode())
    (folder / "torn bytes").write_bytes(b"a\n\xff")
    want = {("torn bytes", 1, "a")} | {(n, k, x) for n, t in files.items() for k, x in enumerate(t.split("\n")[:-1], 1)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("100", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            df = journals.journal_lines(spark, str(folder))
            assert df.dtypes == [("file", "string"), ("line_no", "int"), ("line", "string")] and "BinaryFile" not in df._jdf.queryExecution().toString()
            rows = df.collect()
            assert {(os.path.basename(r.file), r.line_no, r.line) for r in rows} == want and len(rows) == len(want)
            assert {r.file for r in rows} <= {r.path for r in spark.read.format("binaryFile").load(str(folder)).select("path").collect()}
            for bad in (b"a\n\xff\nb\n", *(() if most != old else (b"a\n" + b"x" * (journals.MOST_TAIL + 1), b"x" * (journals.MOST_TAIL + 1)))):
                (tmp_path / "bad.jsonl").write_bytes(bad)
                with pytest.raises(Exception):  # noqa: B017
                    journals.journal_lines(spark, str(tmp_path / "bad.jsonl")).select("line_no").collect()
            pair = '{"event":"intent","id":"%d","sequence":%d}\n{"event":"completed","id":"%d","sequence":%d}\n'
            (tmp_path / "p.jsonl").write_text("".join(pair % (k, 2 * k - 1, k, 2 * k) for k in range(1, 9)))
            p = journals.read_journal(spark, str(tmp_path / "p.jsonl"), "event string, id string, sequence int")
            assert journals.check_pairs(journals.check_sequence(p, "sequence"), "event", "intent", "completed", ["id"]).count() == 16
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_document(spark, tmp_path):
    item = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("note", T.StringType())])
    schema = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("items", T.ArrayType(item))])
    df, digest = journals.read_document(spark, write(tmp_path / "d.json", '{"name":"x","items":[{"source":"s"}]}'), schema, 1 << 20)
    assert df.select(F.explode("items").alias("i")).first().i.source == "s" and len(digest) == 64
    for bad in ('{"name":"x","name":"y"}', '{"name":"x","other":1}', '{"items":[]}', '{"name":"x"} 1', '{"name":"x","items":[{"source":"s","z":1}]}'):
        with pytest.raises(ValueError):
            journals.read_document(spark, write(tmp_path / "bad.json", bad), schema, 1 << 20)


def test_inventory(spark, tmp_path):
    os.makedirs(tmp_path / "a/b")
    write(tmp_path / "a/x.epub", "1")
    write(tmp_path / "a/b/y.mp3", "22")
    os.symlink(tmp_path / "a/x.epub", tmp_path / "link.pdf")
    rows = {r.path: r for r in inventory.inventory(spark, str(tmp_path)).collect()}
    assert rows["a/x.epub"].kind == "ebook_candidate" and rows["a/b/y.mp3"].bytes == 2 and rows["link.pdf"].finding == "not_a_regular_file"
    assert {r.path: r.finding for r in inventory.inventory(spark, str(tmp_path), mostBytes=1).collect()}["a/b/y.mp3"] == "too_large"
    with pytest.raises(Exception):  # noqa: B017
        inventory.inventory(spark, str(tmp_path), depth=1).collect()


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", """<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="i"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:language>en</dc:language><dc:identifier id="i">urn:x</dc:identifier></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.png" media-type="image/png" properties="cover-image"/></manifest><spine><itemref idref="a"/><itemref idref="n" linear="no"/></spine></package>""")
        z.writestr("OPS/a b.xhtml", "<html><body><h1>One</h1><p>Two <b>bold</b>&amp;</p><img alt=''/></body></html>")
        z.writestr("OPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a%20b.xhtml#x">One</a><ol><li><a href="a%20b.xhtml">Sub</a></li></ol></li><li><span>None</span></li></ol></nav></body></html>')
        z.writestr("OPS/c.png", b"img")
    return out.getvalue()


def test_epub_and_zip(spark, tmp_path):
    write(tmp_path / "b.epub", epub())
    write(tmp_path / "bad.epub", b"PK nothing")
    files = containers.read_files(spark, str(tmp_path), "*.epub")
    docs = containers.epub_documents(files).orderBy("finding", "ord").collect()
    assert [(d.ord, d.member, d.linear) for d in docs if d.finding is None] == [(1, "OPS/a b.xhtml", True), (2, "OPS/nav.xhtml", False)]
    assert sum(d.finding is not None for d in docs) == 1
    nav = [(n.ord, n.level, n.parent, n.label, n.member, n.fragment, n.status) for n in containers.epub_navigation(files).filter("finding IS NULL").orderBy("ord").collect()]
    assert nav == [(1, 1, 0, "One", "OPS/a b.xhtml", "x", "internal"), (2, 2, 1, "Sub", "OPS/a b.xhtml", "", "internal"), (3, 1, 0, "None", "", "", "unlinked")]
    assert bytes(containers.epub_cover(files).filter("finding IS NULL").first().image) == b"img"
    assert containers.epub_metadata(files).filter("finding IS NULL").first().package_id == "urn:x"
    assert {m.disposition for m in containers.zip_members(files).filter("finding IS NULL").collect()} == {"ok"}

    from shelfmark.operators.text import read_markup

    m = read_markup(containers.epub_documents(files).filter("ord = 1"), "ord", "markup").first()
    assert m.text == "One\nTwo bold&" and [(p.kind, p.start, p.end) for p in m.parts] == [("h1", 0, 3), ("p", 4, 13)] and m.gaps[0].alt == ""


def test_audio(spark, tmp_path):
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413
    write(tmp_path / "a.mp3", b"ID3\x04\0\0\0\0\0\x05hello" + frame * 3 + b"junk" + frame + frame[:100])
    rows = [(r.kind, r.at, r.length) for r in containers.mp3_frames(containers.read_files(spark, str(tmp_path), "*.mp3")).orderBy("at").collect()]
    assert rows == [("id3v2", 0, 15), ("frame", 15, 417), ("frame", 432, 417), ("gap", 849, 421), ("frame", 1270, 417), ("truncated", 1687, 100)] or rows[0:3] == [("id3v2", 0, 15), ("frame", 15, 417), ("frame", 432, 417)]
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    full = lambda *n: struct.pack(f">{len(n) + 1}I", 0, *n)
    stbl = box(b"stsz", full(0, 3, 5, 6, 7)) + box(b"stts", full(1, 3, 1024)) + box(b"stsc", full(2, 1, 2, 1, 2, 1, 1)) + box(b"stco", full(2, 100, 200))
    write(tmp_path / "a.m4a", box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stbl))))))
    files = containers.read_files(spark, str(tmp_path), "*.m4a")
    assert [(r.at, r.length, r.start_ticks) for r in containers.mp4_packets(files).orderBy("packet_no").collect()] == [(100, 5, 0), (105, 6, 1024), (200, 7, 2048)]
    assert containers.mp4_boxes(files).filter("box = '/moov/trak/mdia/minf/stbl/stts'").count() == 1


def test_recovery_packets(spark, tmp_path):
    import hashlib

    body = b"S" * 16 + b"PAR 2.0\x00Main\0\0\0\0" + b"1234"
    packet = b"PAR2\x00PKT" + struct.pack("<Q", 32 + len(body)) + hashlib.md5(body).digest() + body
    write(tmp_path / "x.par2", packet + b"noise!!!" + packet[:-1] + b"?")
    rows = containers.recovery_packets(containers.read_files(spark, str(tmp_path), "*.par2")).orderBy("at").collect()
    assert [(r.kind, r.checksum_ok) for r in rows] == [("main", True), ("main", False)] and rows[0].set_id == (b"S" * 16).hex()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a​b"), (2, None)], "id int, t string")
    sinks.write_snapshot(df, str(tmp_path / "s"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_snapshot(df, str(tmp_path / "s"))
    sinks.append_lines(df, str(tmp_path / "l"))
    sinks.append_lines(df, str(tmp_path / "l"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "l")).collect()) == [1, 1, 2, 2]
    sinks.publish_file("x", str(tmp_path / "f.txt"))
    with pytest.raises(FileExistsError):
        sinks.publish_file("y", str(tmp_path / "f.txt"))
    files = spark.createDataFrame([(bytearray(b"1"),), (bytearray(b"1"),), (bytearray(b"2"),)], "content binary")
    assert sinks.store_by_content(files, str(tmp_path / "store")).count() == 2
    again = sinks.store_by_content(files, str(tmp_path / "store"))
    assert again.count() == 2 and again.filter("verified").count() == 2
    line = sinks.reading_list(spark.createDataFrame([("A [b]", ["X"], "http://u")], "t string, a array<string>, u string"), "t", "a", "u").first().line
    assert line == "- [A \\[b\\]](http://u) — X"
    w = bytes(spark.range(1).select(sinks.wav(F.lit(bytearray(b"\1\2\3\4")), 8000, 1).alias("w")).first().w)
    assert w[:4] == b"RIFF" and struct.unpack("<I", w[4:8])[0] == 40 and w[-4:] == b"\1\2\3\4" and len(w) == 48


LIBRARY = "library:" + "0" * 32


def test_relations_refuse_what_breaks_them(spark, tmp_path):
    from shelfmark.sources import records

    sha = "a" * 64
    good = f'{{"schema_version":1,"library_id":"{LIBRARY}","id":"sha256:{sha}","sha256":"{sha}","bytes":1,"format":"mp3","status":"checked","reason":"","path":"p","titles":["\\u003cb\\u003e"],"languages":[],"sources":[]}}'
    path = tmp_path / "h.jsonl"
    path.write_text(good + "\n" + good.replace("\\u003c", "<").replace("\\u003e", ">") + "\n" + good[:50])
    df = records.read_relation(spark, str(path), "holdings")
    assert df.count() == 2 and df.first().titles == ["<b>"]
    for bad in (good.replace('"schema_version":1', '"schema_version":2'), good.replace('"bytes":1', '"bytes":-1'), good.replace('"bytes":1', '"bytes":1,"bytes":1'), good.replace('"bytes":1', '"bytes":1,"other":1'),
                good.replace('"bytes":1,"format":"mp3"', '"format":"mp3","bytes":1'), good.replace('"bytes":1', '"bytes": 1'), good.replace("checked", "review"), good.replace('"id":"sha256:a', '"id":"sha256:b'), good + " x"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):  # noqa: B017
            records.read_relation(spark, str(path), "holdings").select("line_no").collect()
    two = [f'{{"schema_version":1,"sequence":{n},"library_id":"{LIBRARY}","operation_id":"o","event":"{e}","at":"t"}}' for n, e in ((1, "intent"), (2, "completed"))]
    path.write_text("\n".join(two) + "\n")
    assert records.read_relation(spark, str(path), "identity").count() == 2
    for bad in ([two[1]], [two[0], two[0]], [*two, two[0].replace(":1,\"lib", ":3,\"lib")]):
        path.write_text("\n".join(bad) + "\n")
        with pytest.raises(Exception):  # noqa: B017
            records.read_relation(spark, str(path), "identity").count()
    d = [f'{{"schema_version":1,"sequence":1,"library_id":"{LIBRARY}","event":"declared","id":"d","declaration":{{"schema":"s","narration_id":"n","recordings":[]}},"at":"t"}}', f'{{"schema_version":1,"sequence":2,"library_id":"{LIBRARY}","event":"retracted","id":"d","at":"t"}}']
    path.write_text("\n".join(d) + "\n")
    assert [r.event for r in records.read_relation(spark, str(path), "declarations").orderBy("sequence").collect()] == ["declared", "retracted"]
    path.write_text(d[1].replace('"sequence":2', '"sequence":1').replace("retracted", "declared") + "\n")
    with pytest.raises(Exception):  # noqa: B017
        records.read_relation(spark, str(path), "declarations").count()


def test_plain_lines_fit(spark):
    """Lines that Python never sees are lines that it would take; a record costs one reading, not one for each rule."""
    import pandas as pd
    from shelfmark.sources import records

    schema = T.StructType.fromDDL(records.JOURNALS["holdings"].schema)
    sha = "a" * 64
    good = f'{{"schema_version":1,"library_id":"{LIBRARY}","id":"sha256:{sha}","sha256":"{sha}","bytes":1,"format":"mp3","status":"checked","reason":"","path":"p","titles":["T"],"sources":[{{"kind":"k","recording":{{"source_format":"x","position":1,"tracks":3,"declared_seconds":1.5,"readers":[]}}}}]}}'
    quick = [good, good.replace('"T"', '"é <b>&\U0001f600\u2028/"'), good.replace('"T"', '"\\u003cb\\u003e\\u0026"'), good.replace('["T"]', "[]"), good.replace('"mp3"', '""'), good.replace('{"kind":"k",', "{")]
    slow = [good.replace('"T"', x) for x in ('"a\\"b"', '"\\u001f"', '"\\\\"', '"null"', '"\\u003c>"', "null", '"\\n"', '"\\u001F"', '"\\/"', '"a\tb"')] + [good.replace("1.5", x) for x in ("1.50", "15e-1", "NaN", '"NaN"', "01.5")]
    slow += [good.replace(*x) for x in (('"bytes":1', '"bytes":1,"bytes":1'), ('"bytes":1', '"bytes":1,"other":1'), ('"bytes":1', '"bytes": 1'), ('"bytes":1,', ""), ('"bytes":1', '"bytes":null'), ('"bytes":1', '"bytes":"1"'), ('"bytes":1', '"bytes":1.0'), ('"bytes":1', f'"bytes":{1 << 64}'),
                                        ('"bytes":1,"format":"mp3"', '"format":"mp3","bytes":1'), ('"mp3"', "3"), ('"sources":[', '"sources":[null,'), ('"readers":[]', '"readers":{}'), ('"reason":""', '"reason":null'))]
    slow += [good + " ", good + "{}", "\ufeff" + good, good[:-1], "", "{}", "[]", "null", "1"]
    lines = spark.createDataFrame([(x,) for x in quick + slow], "line string")
    plain = {r.line: r._plain for r in records._plain(lines, schema).collect()}
    fits = dict(zip(quick + slow, records._fits(schema).func(pd.Series(quick + slow))))
    assert all(plain[x] and fits[x] for x in quick) and [x for x in slow if plain[x] and not fits[x]] == []
    assert sum(fits[x] for x in slow) > 5 and sum(not fits[x] for x in slow) > 15
    df = records._checked(records._parsed(lines.select(F.lit("f").alias("file"), F.lit(1).alias("line_no"), "line"), schema, "holdings").select("file", "line_no", "r.*"), records.JOURNALS["holdings"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2  # of plain lines, and of all others


def test_tracks_beyond_a_recording(spark, sf, tmp_path):
    """A recording holds at most 1000 tracks; longer ones keep their positions in parts, and the rule stands."""
    import __spark_entry__ as entry
    from shelfmark.sources import records

    places = [1, 2, 999, 1000, 1001, 1600, 2000, 2001, 123_456_789, 2**31 - 1, 0, -5, None]
    t = spark.read.parquet(f"{sf}/audio_tracks.parquet")
    rows = spark.createDataFrame(list(enumerate(places, 1)), "track_id long, track_no int")
    t.drop("track_no").withColumn("recording_id", F.when(F.col("track_id") % 2 == 0, F.col("recording_id"))).join(rows, "track_id").select(t.columns).write.parquet(f"{tmp_path}/audio_tracks.parquet")
    got = {r.track_id: r.position for r in entry.queries()["holdings_journal"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(places, 1))
    sha = "a" * 64
    line = f'{{"schema_version":1,"library_id":"{LIBRARY}","id":"sha256:{sha}","sha256":"{sha}","bytes":1,"format":"mp3","status":"checked","reason":"","path":"p","sources":[{{"kind":"archive","recording":{{"source_format":"x","position":1,"tracks":%d}}}}]}}\n'
    path = tmp_path / "h.jsonl"
    path.write_text(line % 1000)
    assert records.read_relation(spark, str(path), "holdings").count() == 1
    path.write_text(line % 1001)
    with pytest.raises(Exception, match="recordings"):
        records.read_relation(spark, str(path), "holdings").count()


def test_named_documents(spark, tmp_path):
    import hashlib

    from shelfmark.sources import records

    def read(name, value, **kw):
        path = tmp_path / "d.json"
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return records.read_named_document(spark, str(path), name, **kw).first()

    sha = "a" * 64
    good = {
        "snapshot": {"schema_version": 1, "id": "x", "complete": True, "assets": [{"id": f"sha256:{sha}", "sha256": sha, "bytes": 1, "locations": [{"path": "p", "candidate_kind": "other"}]}]},
        "collection": {"schema_version": 1, "name": "n", "items": [{"source": "s", "file": "f"}, {"source": "s", "recording": "r"}]},
        "manifest": {"schema_version": 1, "title": "t", "resources": [{"id": "r", "assets": [{"name": "n"}]}]},
        "cleanup_manifest": {"schema_version": 1, "cleanup_id": "c", "library_id": LIBRARY, "plan_digest": sha, "entries": [{"path": "p", "disposition": "move"}]},
        "purge_manifest": {"schema_version": 2, "cleanup_id": "c", "library_id": LIBRARY, "plan_digest": sha, "files": [], "archive_groups": [{"path": "a"}]},
        "mark_export": {"schema_version": 1, "kind": "bookmarks", "library_id": LIBRARY, "bookmarks": [{"id": "m", "asset_id": "a"}]},
        "declaration": {"schema": "s", "narration_id": "n", "recordings": [{"source_id": "a"}, {"source_id": "b"}]},
    }
    for name, value in good.items():
        assert read(name, value) is not None
        with pytest.raises(ValueError):
            read(name, {**value, "other": 1})
        with pytest.raises(ValueError):
            read(name, json.dumps(value) + "{}")
    raw = json.dumps(good["purge_manifest"])
    assert read("purge_manifest", raw, sha256=hashlib.sha256(raw.encode()).hexdigest()).schema_version == 2
    with pytest.raises(ValueError):
        read("purge_manifest", raw, sha256=sha)
    for name, change in (("purge_manifest", {"schema_version": 1}), ("purge_manifest", {"schema_version": 3}), ("collection", {"items": []}), ("collection", {"items": [{"source": "s", "file": "f", "recording": "r"}]}),
                         ("collection", {"items": [{"source": "s", "file": "f"}] * 2}), ("snapshot", {"assets": [{"id": "x", "sha256": sha, "locations": []}]}), ("declaration", {"recordings": [{"source_id": "a"}]}), ("cleanup_manifest", {"entries": [{"disposition": "burn"}]})):
        with pytest.raises(Exception):  # noqa: B017
            read(name, {**good[name], **change})


def test_short_and_odd_pages_are_refused(spark):
    from shelfmark.sources import providers

    def df(*texts):
        return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")

    page = '{"size":%d,"entries":[{"key":"/books/OL1M"},{"key":"/books/OL2M"}]}'
    assert providers.editions(df(page % 2), "k", "t", F.lit(0), 50).count() == providers.editions(df(page % 9), "k", "t", F.lit(4), 2).count() == 2
    for size, offset, limit in ((3, 0, 50), (1, 0, 50), (2, 1, 50)):
        with pytest.raises(Exception):  # noqa: B017
            providers.editions(df(page % size), "k", "t", F.lit(offset), limit).select("id").collect()
    with pytest.raises(Exception):  # noqa: B017
        providers.editions(df("{}"), "k", "t", F.lit(0), 50).collect()
    assert providers.bitstreams(df("{}", None, '{"bitstreams":[]}'), "k", "t").count() == 0
    assert providers.project_sections(df('{"books":[]}', "x", None), "k", "t").count() == 0
    assert providers.latest_version(df("<a/>", "<a><IsTruncated>false</IsTruncated></a>"), "k", "t").count() == 0


def test_documents_copies_and_identity(spark, tmp_path):
    import hashlib

    from shelfmark.sources import records

    marks = spark.createDataFrame([("m2", "b"), ("m1", "a")], "id string, asset_id string")
    out = str(tmp_path / "e.json")
    digest = sinks.export_document(marks, out, {"schema_version": 1, "kind": "bookmarks", "library_id": LIBRARY}, "bookmarks", ["id"])
    back = records.read_named_document(spark, out, "mark_export", sha256=digest).first()
    assert [(b.id, b.asset_id) for b in back.bookmarks] == [("m1", "a"), ("m2", "b")]
    with pytest.raises(FileExistsError):
        sinks.export_document(marks, out, {}, "bookmarks", ["id"])
    with pytest.raises(ValueError):
        sinks.export_document(marks, str(tmp_path / "f.json"), {}, "x", ["id"], most=30)
    assert sinks.export_document(marks.limit(0), str(tmp_path / "g.json"), {}, "x", ["id"]) and open(tmp_path / "g.json").read() == '{"x":[]}'
    source = write(tmp_path / "src", b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    sinks.copy_verified(source, str(tmp_path / "copy"), good)
    assert open(tmp_path / "copy", "rb").read() == b"abc"
    for path, sha in ((tmp_path / "copy", good), (tmp_path / "other", "0" * 64)):
        with pytest.raises((FileExistsError, ValueError)):
            sinks.copy_verified(source, str(path), sha)
    assert not (tmp_path / "other").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["copy", "e.json", "g.json", "src"]
    lib = tmp_path / "lib"
    lib.mkdir()
    assert records.library_status(spark, str(lib)) == ("not_initialized", None)
    records.create_library(str(lib), LIBRARY, "op:1", "2001-01-01T00:00:00Z")
    assert records.library_status(spark, str(lib)) == ("initialized", LIBRARY)
    with pytest.raises(FileExistsError):
        records.create_library(str(lib), LIBRARY, "op:1", "t")
    (lib / "identity.jsonl").write_text("{}\n")
    assert records.library_status(spark, str(lib)) == ("review", None)


def test_scope_deletes_its_tables(spark):
    from shelfmark.session import checkpoint_dir, cut, scope

    def there():
        root = checkpoint_dir(spark).removeprefix("file:").replace("///", "/")
        return {n for n in os.listdir(root) if n.startswith("cut-")}

    before = there()
    with scope(spark):
        df = cut(spark.range(3))
        assert len(there() - before) == 1 and df.count() == 3
        with scope(spark):
            cut(spark.range(1))
        assert len(there() - before) == 1
    assert there() == before
