import random

import numpy as np

from shelfmark.llm.leaks import ERROR_EVERY, LEAST, MIN_WORDS, SHINGLE, WINDOWS, Passages, leaks, words


def brute(doc, passage):
    """Longest allowed stretch by trying every pair of word ranges with edit distance over rows."""
    best = 0
    for i in range(len(passage)):
        prev = {0: 0}  # for each place of the document: least errors of passage[i:x] against a range that ends there
        row = [0] * (len(doc) + 1)
        for x in range(i, len(passage)):
            new = [row[0] + 1]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (passage[x] != doc[j - 1])))
            row = new
            n = x - i + 1
            if n >= MIN_WORDS and min(row) * ERROR_EVERY <= n:
                best = max(best, n)
        del prev
    return best


def test_words():
    assert words("He said: “Don’t” &amp; <i>wént</i> exam-\n  ple a_b") == ["he", "said", "dont", "went", "example", "a", "b"]
    assert words('{"t": "l\\u2019\\u00e9t\\u00e9\\nvu"}') == ["t", "lete", "vu"]
    assert words("Ｗｉｄｅ Сasе") == ["wide", "case"] and words(None) == words("") == []


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 40, 70]))] for _ in range(8)]
    docs, kinds = [], []
    for k in range(120):
        p = rng.choice(passages)
        n = rng.choice([8, 13, 16, 18, 24, 32, 40])
        a = rng.randrange(0, max(1, len(p) - n + 1))
        part = p[a : a + n]
        for _ in range(rng.choice([0, 0, 1, 2, 3, n // 8, n // 5])):
            at = rng.randrange(len(part))
            part = part[:at] + rng.choice([[], ["zz"], ["zz", part[at]]]) + part[at + 1 :]
        docs.append([f"x{rng.randrange(999)}" for _ in range(rng.randrange(30))] + part + [f"y{rng.randrange(999)}" for _ in range(rng.randrange(30))])
        kinds.append(n)
    d = spark.createDataFrame([(k, " ".join(x), 1) for k, x in enumerate(docs)], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(passages)], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    want = {(a, b) for a, x in enumerate(docs) for b, p in enumerate(passages) if brute(x, p)}
    # the brute force also counts stretches that end in an error, which the definition does not
    assert got <= want
    assert got == {(a, b) for a, x in enumerate(docs) for b, p in enumerate(passages) if trimmed(x, p)}
    blocks = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "passage", max_shingles=60).collect()}
    assert blocks == got and len(got) > 30


def test_forms_copies_nulls_and_shared_passages(spark):
    p = "The quick brown fox didn’t jump over any lazy dog while seventeen café owners watched from the warm harbour wall"
    rows = [(1, "Intro. " + p.upper() + " End."), (2, p.replace(" ", "\n> ")), (3, None), (4, ""), (5, " ".join(p.split()[:14])), (6, "x " * 50), (7, p), (8, p),
            (9, "<p>" + p.replace("é", "é").replace("’", "&#8217;") + "</p>"), (10, p.replace("brown", "red").replace("warm ", ""))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    i = spark.createDataFrame([(1, p), (2, p), (3, None), (4, ""), (5, "too short a passage")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    assert got == {(k, n) for k in (1, 2, 7, 8, 9, 10) for n in (1, 2)}
    assert leaks(d, "doc_id", "text", i.filter("item_id > 2"), "item_id", "passage").count() == 0
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0


def test_prefix_is_necessary_and_leaves_half_out():
    """No allowed choice of errors destroys every kept shingle of a window, and about half of all are left out."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(n)) for n in (15, 16, 24, 60, 300)]
    p = Passages(texts)
    index = p.prefix(np.array([rng.randrange(50) for _ in p.codes]))
    kept = {(q, i) for q, i in zip(index.q.tolist(), index.i.tolist())}
    assert LEAST == 8 and WINDOWS == [(14, 7), (22, 10)] and not any(q == 0 for q, _ in kept)
    for q, ids in enumerate(p.ids[1:], 1):
        m = len(ids) - SHINGLE + 1
        for w, need in WINDOWS:
            for a in range(m - w + 1):
                assert sum((q, i) in kept for i in range(a, a + w)) >= need
    assert index.share < 0.58
    # of two shingles the commoner one is left out
    common = p.prefix(np.where(np.arange(len(p.codes)) % 2, 1, 1000))
    per = np.diff(common.at)
    assert per[1::2].mean() > 2 * per[::2].mean()


def test_long_tags_and_comments(spark):
    w = [f"w{k}" for k in range(24)]
    link = "<a href='" + "x" * 2000 + "' title=\"a > b\">"
    docs = [(1, " ".join(w[:8]) + link + " ".join(w[8:]) + "</a>"), (2, " ".join(w[:8]) + "<!-- " + "y " * 3000 + "-->" + " ".join(w[8:])), (3, "<!-- " * 5000 + " ".join(w)), (4, " ".join(w[:9]) + " a<b " + " ".join(w[9:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(w))], "item_id long, passage string")
    assert {r.doc_id for r in leaks(d, "doc_id", "text", i, "item_id", "passage").collect()} == {1, 2, 3, 4}


def test_refrains(spark):
    passages = [" ".join([f"{w}{k}" for k in range(period)] * times) for w, period, times in [("a", 1, 90), ("b", 3, 40), ("c", 4, 34), ("d", 4, 40), ("e", 8, 60)]]
    docs = [(n, f"before {p} after") for n, p in enumerate(passages)] + [(9, "e7 " + " ".join(f"e{k}" for k in range(5)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r.n_words for r in leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    assert set(got) == {(n, n) for n in range(5)} and all(v >= MIN_WORDS for v in got.values())


def trimmed(doc, passage):
    """Longest allowed stretch that begins and ends with words found in the document, by edit distance over rows."""
    best = 0
    for i in range(len(passage)):
        row = None  # least errors of passage[i:x] against a range that ends at each place of the document
        for x in range(i, len(passage)):
            same = [passage[x] == w for w in doc]
            if row is None:
                ends = [float("inf"), *(0 if s else float("inf") for s in same)]
                row = ends
                continue
            new, ends = [row[0] + 1], [float("inf")]
            for j in range(1, len(doc) + 1):
                ends.append(row[j - 1] if same[j - 1] else float("inf"))
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (not same[j - 1])))
            row = new
            n = x - i + 1
            if n >= MIN_WORDS and min(ends) * ERROR_EVERY <= n:
                best = max(best, n)
    return best


def test_misses_are_exactly_the_stretches_that_end_in_an_error(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 40]))] for _ in range(6)]
    docs = []
    for k in range(120):
        p = rng.choice(passages)
        n = rng.choice([14, 15, 16, 17, 18, 20])
        a = rng.randrange(0, len(p) - n + 1)
        part = p[a : a + n]
        for at in rng.choice([[], [0], [n - 1], [0, n - 1], [1], [n // 2], [n // 2, n - 1]]):
            part[at] = "zz"
        docs.append([f"x{k}" for k in range(rng.randrange(9))] + part + ["y"] * rng.randrange(9))
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(passages)], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    assert got == {(a, b) for a, x in enumerate(docs) for b, p in enumerate(passages) if trimmed(x, p)}
    assert got < {(a, b) for a, x in enumerate(docs) for b, p in enumerate(passages) if brute(x, p)}


def test_odd_texts_of_any_length_take_time_in_proportion():
    import time

    for text in ("<a " * 100_000, "<a x='" * 100_000, "&amp;" * 100_000, "\\u00e9" * 50_000, "<!--" * 100_000, "%41" * 100_000, "a-\n" * 100_000, "a'" * 100_000):
        began = time.time()
        words(text)
        assert time.time() - began < 5
