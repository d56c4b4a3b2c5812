import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import codecs as C
from shelfmark.functions import scalars as S
from shelfmark.operators import search


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first().asDict()


def table(spark, f, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_identifiers(spark):
    assert table(spark, S.isbn10_ok, ["0306406152", "080442957X", "0306406153", "", None, "X306406152"]) == [True, True, False, False, False, False]
    assert table(spark, S.isbn13_of, ["0306406152", "0306406153"]) == ["9780306406157", None]
    assert table(spark, S.isbn13_ok, ["9780306406157", "9780306406158", None]) == [True, False, False]
    assert table(spark, S.clean_isbn, ["urn:isbn:0-306-40615-2"]) == ["0306406152"]
    assert table(spark, S.canonical_doi, ["https://doi.org/10.1000/ABC", "doi: 10.1000/x", "10.1000/a/../b", "11.1/x"]) == ["10.1000/abc", "10.1000/x", None, None]
    assert table(spark, S.open_library_key, ["/books/OL7M", "ol12w", "OL0M"]) == ["OL7M", "OL12W", None]
    got = table(spark, S.arxiv_parts, ["arxiv:2101.00001v2", "arxiv:hep-th/9901001", "arxiv:2113.00001", "arxiv:0704.0001", "2101.00001", "arxiv:2301.1234", "arxiv:9912.12345", "arxiv:0703.0001", "arxiv:1412.0001", "arxiv:1501.0001", "arxiv:math.GT/0309136",
                                       "arxiv:hep-th/9107001", "arxiv:hep-th/0703001", "arxiv:hep-th/0704001", "arxiv:hep-th/0801001", "arxiv:2101.00001v0", None])
    assert [g and tuple(g) for g in got] == [("2101.00001", 2), ("hep-th/9901001", 0), None, ("0704.0001", 0), None, None, ("9912.12345", 0), None, ("1412.0001", 0), None, None, None, ("hep-th/0703001", 0), None, None, None, None]


def test_lists_languages_and_dates(spark):
    assert table(spark, S.split_list, [" a ; ;b c", "", None]) == [["a", "b c"], [], []]
    assert table(spark, S.split_codes, ["en; fr", "en, fr", "a, long name, here", "en"]) == [["en", "fr"], ["en", "fr"], ["a, long name, here"], ["en"]]
    assert table(spark, S.language_base, ["eng", "iw", "fre", "en-GB", "English", "und", None]) == ["en", "he", "fr", "en", None, None, None]
    assert table(spark, lambda c: S.language_match(c, "en"), [["eng"], ["fr"], ["und"], []], "array<string>") == [True, False, None, None]
    assert table(spark, S.date_shape, ["2020-13-99", "2020-1-1", None]) == [True, False, None]


def test_numbers(spark):
    assert table(spark, S.track_number, ["7", "07", "7/12", "x", "12345"]) == [7, 7, 7, 0, 0]
    assert table(spark, S.declared_seconds, ["507.1", "08:26", "1:02:03", "1:60", "-1", "", "1:2:3:4"]) == [507.1, 506.0, 3723.0, 0.0, 0.0, 0.0, 0.0]
    assert table(spark, S.roman, [4, 1994, 0], "int") == ["iv", "mcmxciv", "0"]
    assert table(spark, S.letters_label, [1, 26, 27, 2601], "int") == ["a", "z", "aa", "2601"]
    assert one(spark, a=S.scaled_ms(F.lit(9223372036854775807), F.lit(1)), b=S.scaled_ms(F.lit(90000), F.lit(90000)), c=S.scaled_ms(F.lit(5), F.lit(0))) == {"a": 9223372036854775807, "b": 1000, "c": 0}
    assert table(spark, S.packed_language, [(5 << 10) | (14 << 5) | 7], "int") == ["eng"]
    assert table(spark, S.syncsafe, [0x00000201], "long") == [257]


def test_files_and_words(spark):
    assert table(spark, S.file_kind, ["a/B.EPUB", "x.mp3", "x.tar.gz", "noext", "v.par2"]) == ["ebook_candidate", "audio_candidate", "archive_candidate", "other", "recovery_data"]
    heads = [b"PK\x03\x04abcd", b"%PDF-1.4", b"ID3\x04", b"\xff\xfb\x90\x00", b"\0\0\0\x20ftypM4A", b"Rar!", b"MZ", b"", b"plain"]
    assert table(spark, S.detected_format, [bytearray(h) for h in heads], "binary") == ["zip", "pdf", "mp3", "mp3", "mp4", "rar", "executable", "unknown", "unknown"]
    got = table(spark, S.volume_of, ["b.part02.rar", "b.7z.001", "b.r00", "b.z01", "b.rar"])
    assert [g and tuple(g) for g in got] == [("b", 2, "part"), ("b", 1, "7z"), ("b", 2, "old"), ("b", 1, "segment"), None]
    assert table(spark, S.pause_class, ["end.”", "so,", "word", "Why?)"]) == ["sentence", "clause", "none", "sentence"]
    assert table(spark, S.flag_state, [None, "", "TRUE", '"0"', "maybe"]) == ["not_declared", "not_declared", "true", "false", "unknown"]
    assert table(spark, S.portable_path, ["a/b.txt", "../a", "a//b", "a/b.", "con?"]) == [True, False, False, False, False]


def test_codecs(spark):
    assert C.canonical_json(C.strict_json('{"b": 1.50, "a": [true, null]}')) == '{"a":[true,null],"b":1.50}'
    assert not C.is_canonical('{"b":1,"a":2}') and C.is_canonical('{"a":2,"b":1}')
    for bad in ('{"a":1,"a":2}', "[NaN]", "[1] x", "[" * 20 + "]" * 20):
        with pytest.raises(ValueError):
            C.strict_json(bad)
    t = C.position_token(unit=3, offset=17)
    assert C.read_token(t) == {"unit": 3, "offset": 17} and "=" not in t
    with pytest.raises(ValueError):
        C.read_token("eyJhIjogMX0")  # white space in the JSON
    assert C.resolve_href("text/a.xhtml", "../img/x%20y.png#f") == ("img/x y.png", "f", "internal")
    assert C.resolve_href("a.xhtml", "../../x")[2] == "invalid" and C.resolve_href("a", "https://x.y")[2] == "external"
    assert C.visible_escapes("a​b\n") == "a\\u200bb\\u000a" and C.byte_cut("aé", 2) == "a"
    assert C.grapheme_chunks("éab", 2) == ["éa", "b"]
    assert table(spark, C.canonical_digest_udf, ['{"a":1}', "{", None])[1:] == [None, None]
    assert json.loads(C.canonical_json(C.strict_json('{"x":"é"}'))) == {"x": "é"}


def test_parameters_are_refused_before_a_job(spark):
    df = spark.range(3)
    for bad in ((0, 0), (51, 0), (10, -1), (10, 10_001)):
        with pytest.raises(ValueError):
            search.page(df, [F.col("id")], *bad)
    with pytest.raises(ValueError):
        search.ranked(df, "  ", "id", "id", F.array(), F.array())
