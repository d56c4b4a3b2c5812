import random

from shelfmark.operators.packed import fold, read_enclosed, read_json, readings, split_packed

SCHEMA = "row_id long, authors string, subjects string, item int"


def run(spark, rows, fields=("subjects",)):
    df = spark.createDataFrame([(k, None, r, 0) for k, r in enumerate(rows)], SCHEMA)
    out = {}
    for r in split_packed(df, "row_id", list(fields)).collect():
        out.setdefault(r.row_id, []).append((r.pos, r.item))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


def test_readings_of_one_field():
    assert [v for v, *_ in read_enclosed('"a; b";c ; "d ""e"" f"', frozenset(";"))] == ["a; b", "c", 'd "e" f']
    assert [v for v, *_ in read_enclosed('"Quiet" Series;x', frozenset(";"))] == ['"Quiet" Series', "x"]
    assert [v for v, *_ in read_json('["a \\"b\\"", "", null, "c"]')] == ['a "b"', "c"]
    assert read_json("[Anonymous]") is None and read_json('["a", 1]') is None
    assert readings(None) == readings("") == readings(" 　\n") == []
    assert readings(";;|") == readings(" / ; ") == []
    assert fold(" a  b\n") == "a b"


def test_each_dialect_gives_the_same_values(spark):
    values = ["Tales, northern", "Trades/Handicrafts", "Bells -- Verse", 'So-called "paper rivers"', "Owls -- Fiction"]
    q = lambda v: '"' + v.replace('"', '""') + '"'
    forms = [
        "; ".join(values), "|".join(values), " / ".join(values), "\n".join(values), "\r\n".join(values), "\t".join(values), " • ".join(values),
        " · ".join(values), "；".join(values), ",".join(map(q, values)), ", ".join(map(q, values)), "; " + ";; ".join(values) + " ;",
        '["' + '", "'.join(v.replace('"', '\\"') for v in values) + '"]', f"{q(values[0])}|" + "|".join(values[1:]),
        values[0] + ";" + values[1] + " | " + values[2] + "\n" + ";".join(values[3:]),
    ]
    assert run(spark, forms) == dict(enumerate([values] * len(forms)))


def test_enclosed_separators_repeats_and_empty_fields(spark):
    rows = ['"Plays; Masques"', "Owls; Owls;  ; Owls", None, "", " ", ";", 'Bells; "Plays; Masques"', "one"]
    assert run(spark, rows) == {0: ["Plays; Masques"], 1: ["Owls"] * 3, 6: ["Bells", "Plays; Masques"], 7: ["one"]}


def test_known_values_keep_a_wrapped_line_together(spark):
    rows = ["Tales, northern", "Tales, northern; Owls", "Bells; Tales, northern", "Tales,\nnorthern", "Owls\nBells", "Owls", "Bells"] + [f"w{k}; Tales, northern" for k in range(30)]
    got = run(spark, rows)
    assert got[3] == ["Tales, northern"] and got[4] == ["Owls", "Bells"]


def test_hot_value_long_text_and_empty_table(spark):
    rows = ["Sundry"] * 300 + ["; ".join(f"subject {k}" for k in range(4000))] + [f"a{k} | Sundry" for k in range(50)]
    got = run(spark, rows)
    assert len(got[300]) == 4000 and got[5] == ["Sundry"] and got[310] == ["a9", "Sundry"]
    assert run(spark, []) == {}


def test_random_lists_come_back(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 12))).strip() or "x" for _ in range(40)]
    words = [" ".join(w.split()) for w in words]
    rows, want = [], {}
    for k in range(200):
        vs = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        rows.append(rng.choice(["; ", "|", "\n", "；", ";"]).join(vs))
        want[k] = vs
    assert run(spark, rows) == want


def test_very_long_fields_take_time_in_proportion():
    import time

    for raw, n in (("ab cd;" * 40_000, 2), ('"a ""b"" c"; ' * 20_000, 3), ('""' * 20_000 + ";" + '""' * 20_000 + ";x", 3), ('"a; ' * 20_000, 2)):
        began = time.time()
        assert len(readings(raw)) == n and time.time() - began < 5
    assert len(readings("ab;" * 50_000 + "c")[0]) == 50_001
