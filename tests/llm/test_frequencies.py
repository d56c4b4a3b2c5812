import random
from collections import defaultdict

import pytest

from shelfmark.llm.frequencies import term_frequencies


def brute(rows, n):
    total, texts = defaultdict(int), defaultdict(set)
    for f, t, r in rows:
        if t is not None:
            total[f, t] += 1
            if r is not None:
                texts[f, t].add(r)
            texts[f, t]
    mark = lambda k: "rare" if len(texts[k]) < 3 else "common" if len(texts[k]) > 0.05 * n else "kept"
    return {(f, t, total[f, t], len(texts[f, t]), mark((f, t))) for f, t in total}


@pytest.mark.parametrize("max_bytes", [1, 1500, 64 << 20])
def test_against_brute_force(spark, max_bytes):
    rng = random.Random(2)
    rows = [("s", "hot", k % 700) for k in range(3000)] + [("s", f"t{rng.randrange(400)}", rng.choice([None, *range(900)])) for _ in range(4000)]
    rows += [("b", "hot", 1), ("b", None, 1), ("b", "Hot", None), ("b", "", 2)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "field_name string, term string, record long, n int")
    got = {tuple(r) for r in term_frequencies(df, 900, max_bytes=max_bytes).collect()}
    assert got == brute(rows, 900)
    assert term_frequencies(df.limit(0), 0, max_bytes=max_bytes).count() == 0
