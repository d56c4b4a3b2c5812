from pyspark.sql import functions as F

from shelfmark.operators import compare, folds, groups, search, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_and_marks(spark):
    log = spark.createDataFrame([("a", 1, "save", 5), ("b", 2, "save", 6), ("a", 3, "note", 7), ("a", 4, "save", 8), ("b", 5, "delete", 9), ("c", 6, "note", 1)], "k string, line int, event string, v int")
    assert rows(folds.latest_per_key(log, "k", "line").select("k", "first_line", "line", "v")) == [("a", 1, 4, 8), ("b", 2, 5, 9), ("c", 6, 6, 1)]
    assert rows(folds.mark_fold(log, "k", "line", "event", "save", "note", "delete")) == [("a", 4, None)]
    assert rows(folds.open_operations(log, "k", "line", "event", "save", "delete")) == [("a", 4)]


def test_sequences(spark):
    t = spark.createDataFrame([("r", 1, 10), ("r", 2, None), ("r", 3, 5), ("s", 1, 4), ("s", 2, 4), ("u", 2, 1)], "k string, pos int, ms int")
    assert {(r.k, r.pos): r.start for r in folds.running_start(t, "k", "pos", "ms").collect()} == {("r", 1): 0, ("r", 2): 10, ("r", 3): None, ("s", 1): 0, ("s", 2): 4, ("u", 2): None}
    c = spark.createDataFrame([("t", 1, 0, 5), ("t", 2, 0, 9), ("t", 3, 20, 15), ("w", 4, 7, 30)], "k string, id int, s int, e int")
    got = {r.id: (r.status, r.end) for r in folds.next_starts(c, "k", "s", "e", "id").collect()}
    assert got == {1: ("not_after_start", None), 2: ("bounded", 20), 3: ("end_of_source", 20), 4: ("end_of_source", 30)}
    p = spark.createDataFrame([("k", 5, "p"), ("k", 1, "q"), ("z", 5, "r")], "k string, at int, name string")
    m = spark.createDataFrame([("k", 2, "m2"), ("k", 5, "m5")], "k string, at int, v string")
    assert {r.name: r.v for r in folds.as_of(p, m, "k", "at", "v").collect()} == {"p": "m5", "q": None, "r": None}
    s = spark.createDataFrame([("k", 0, 100, "long"), ("k", 5, 6, "short"), ("k", 6, 9, "after"), ("k", 9, 3, "reversed")], "k string, a int, b int, id string")
    got = folds.covering(p.select("k", "at"), s.unionByName(spark.createDataFrame([("k", -(10**9), 10**9, "huge"), ("z", 6, 7, "beside")], s.schema)), "k", "at", "a", "b", ["id"])
    assert rows(got.select("at", "id")) == [(1, "huge"), (1, "long"), (5, "huge"), (5, "long"), (5, "short")]


def test_comparisons(spark):
    f = lambda *r: spark.createDataFrame(list(r), "k int, s int, d string")
    base, cur = f((1, 5, "a"), (2, 5, "b"), (3, 5, None), (4, 5, "d")), f((1, 5, "a"), (2, 6, "b"), (3, 5, "c"), (9, 1, "z"))
    assert rows(compare.audit(base, cur, "k", "s", "d")) == [(1, "unchanged"), (2, "changed"), (3, "unverified"), (4, "missing"), (9, "added")]
    assert rows(compare.full_diff(base, cur, "k", "d")) == [(1, "same"), (2, "same"), (3, "changed"), (4, "removed"), (9, "added")]
    assert rows(compare.upsert_plan(base, cur, "k", "s", "d", True)) == [(1, "same"), (2, "replace"), (3, "note_only"), (4, "keep"), (9, "add")]
    assert rows(compare.key_check(base, cur, "k")) == [("missing", 4), ("untracked", 9)]
    order = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3)], "g string, k string, p int")
    moved = spark.createDataFrame([("g", "c", 1), ("g", "a", 2), ("g", "x", 3)], "g string, k string, p int")
    assert rows(compare.retained_order(order, moved, "g", "k", "p")) == [("g", "a", 1, 2), ("g", "c", 2, 1)]
    band = lambda *v: spark.createDataFrame([("g", n, float(x)) for n, x in enumerate(v)], "k string, n int, x double")
    assert rows(compare.ordered_band(band(1, 2), band(3, 5), "k", ["n"], "x", 3.0)) == [("g", True, 2)]
    assert rows(compare.ordered_band(band(1, 2, 9), band(3, 5), "k", ["n"], "x", 3.0)) == [("g", False, 3)]
    files = spark.createDataFrame([("i", "o.flac", None, 7), ("i", "d.mp3", "o.flac", None), ("i", "z.mp3", "gone", None)], "k string, name string, original string, track int")
    assert rows(compare.inherit(files, "k", "name", "original", "track").select("name", "track").fillna(-1)) == [("d.mp3", 7), ("o.flac", 7), ("z.mp3", -1)]
    entries = spark.createDataFrame([("a/X", "h1", 3), ("A/x", "h1", 3), ("b", "h1", 3), ("c", "h9", 3), ("d", None, 3), ("e", "h1", 0)], "p string, sha string, n int")
    plan = compare.folder_plan(entries, spark.createDataFrame([("h1",)], "sha string"), "p", "sha", "n")
    assert rows(plan.select("p", "reason")) == [("A/x", "name_clash"), ("a/X", "name_clash"), ("b", "held"), ("c", "not_held"), ("d", "no_digest"), ("e", "empty")]


def test_groups(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, None)], "k int, t string")
    assert sorted(r.copies for r in groups.exact_groups(d, "k", "t").collect()) == [1, 2]
    r = groups.related_groups(d, "k", {"same": F.col("t")})
    assert [(x.key, x.members, x.first_member) for x in r.collect()] == [("x", 2, 1)]
    s = spark.createDataFrame([("a", 1, 10), ("a", 3, 11), ("a", 3, 12), ("b", 1, 5), ("b", 1, 5), ("b", 2, 6)], "k string, p int, asset int")
    assert rows(groups.manifests(s, "k", "p", "asset")) == [("a", 3, 2, 1, 1, False), ("b", 2, 2, 0, 0, True)]
    assert rows(groups.missing_positions(s, "k", "p")) == [("a", 2)]
    assert rows(groups.complete_sets(s, "k", "p").select("k", "reason")) == [("a", "repeated"), ("b", "repeated")]
    assert rows(groups.capped(s, "k", "asset", F.col("p"), 2)) == [("a", 10, 1, 1), ("a", 11, 2, 1), ("b", 5, 1, 0), ("b", 6, 2, 0)]


def test_search_and_text(spark):
    c = spark.createDataFrame([(12, "Lady", ["Austen, Jane"], []), (20, "Austen's life", ["B"], []), (7, "X", [], ["austen country"]), (9, None, None, None)], "n int, t string, a array<string>, s array<string>")
    hits = search.ranked(c, "Austen", "n", "t", F.col("a"), F.col("s"))
    assert [(r.n, r["rank"], r.total) for r in search.with_total(hits, [F.col("rank"), F.col("n")], 2).collect()] == [(20, 0, 3), (12, 1, 3)]
    t = spark.createDataFrame([(1, "aaaa é aa\\E"), (2, None), (3, "")], "k int, t string")
    assert rows(text.locate(t, "k", "t", "aa")) == [(1, 1, 0, 2), (1, 2, 2, 4), (1, 3, 8, 10)]
    assert rows(text.locate(t, "k", "t", "\\E")) == [(1, 1, 10, 12)]
    assert [r.t and (r.t.status, r.t.text, r.t.end) for r in t.select(text.read_range("t", 0, 6).alias("t")).collect()] == [("partial_range", "aaaa ", 5), None, ("complete_range", "", 0)]
    w = text.words_with_offsets(t, "k", "t").orderBy("ord").collect()
    assert [(x.word, x.start_byte) for x in w] == [("aaaa", 0), ("é", 5), ("aa\\E", 8)]
