import unicodedata

from shelfmark.llm.visual import LETTERS, STRUCK, look_alike_pairs, mapping, visible


def test_forms():
    same = [
        ("Ｍａｒｖｕｌ，　Ｌｅｏ", "Marvul, Leo"), ("Nulрeѕinsο, Ν., １７６８－１８５５", "Nulpesinso, N., 1768-1855"), ("a​b­c﻿", "abc"), ("é", "é"),
        ("o\u0338re", "øre"), ("о\u0338re", "øre"), ("а\u0301", "á"), ("ի\r\nx", "ի x"), ("ⲢⲟⲣⲥⲞ", "PopcO"), ("ᎪᏢᎬ", "APE"), ("ꓧꓳꓫ", "HOX"), ("հօս", "hou"),
        ("e​́x", "éx"), ("Part Ⅲ ﬁn", "Part III fin"), ("a   \nb ", "a b"), ("1768‑1855", "1768‐1855"), ("ﾊﾞ", "バ"), ("ÅK", "ÅK"),
    ]
    for a, b in same:
        assert visible(a) == visible(b), (a, b)
    for a, b in [("Works", "works"), ("cafe", "café"), ("a, b", "a b"), ("l’été", "l'été"), ("n°", "no"), ("дом", "dom"), ("x²", "x2"), ("ø", "o"), ("1", "l")]:
        assert visible(a) != visible(b), (a, b)
    assert visible(None) is None and visible("") == visible("​") == ""


def test_one_pass_is_enough():
    m = mapping()
    for k, v in m.items():
        assert visible(v) == visible(k) and not any(c in m for c in v)
    assert all(visible(x) == y for t in (LETTERS, STRUCK) for x, y in t.items())
    for text in ["Ёлка і дом", "ｶﾞｷﾞ", "a​" * 50_000, "́ lone"]:
        assert visible(visible(text)) == visible(text) and unicodedata.is_normalized("NFC", visible(text))


def test_pairs(spark):
    df = spark.createDataFrame([("t", "Café"), ("t", "Café"), ("t", "Café"), ("t", "Café​"), ("n", "Café"), ("t", None), ("t", "CAFÉ"), ("n", "")], "field_name string, text string")
    df = df.selectExpr("field_name", "text", "text AS form", "1 AS t")
    got = {(r.field_name, r.text_a, r.text_b) for r in look_alike_pairs(df, "field_name", "text").collect()}
    texts = sorted(["Café", "Café", "Café​"])
    assert got == {("t", a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]}
    assert look_alike_pairs(df.limit(0), "field_name", "text").count() == 0


def test_long_keys_are_matched_before_short_ones_and_checked(monkeypatch):
    from shelfmark.llm import visual

    m = mapping()
    assert sum(len(k) > 1 for k in m) > 1000 and max(map(len, m)) >= 3
    t = visual.Transducer({"a": "1", "ab": "2", "abc": "3", "c": "4"})
    assert [t.cluster(x) for x in ("a", "ab", "abc", "abd", "aab", "cab")] == ["1", "2", "3", "2d", "12", "42"]
    assert visual._conflicts({"a": "x", "a\u0301": "y"}) and visual._conflicts({"a": "b", "b": "c"}) and not visual._conflicts({"а": "a", "а\u0301": "á"})
