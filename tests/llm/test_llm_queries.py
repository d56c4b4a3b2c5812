import pytest

import __spark_entry__ as entry
from shelfmark.llm.queries import QUERIES

COLUMNS = {
    "p2_found": "name_a string, name_b string", "p3_found": "field_name string, term string, n_total bigint, n_texts bigint, mark string",
    "p5_found": "field_name string, text_a string, text_b string", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows_once(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    assert name in entry.queries()


def test_partitions_do_not_matter(spark, sf):
    from shelfmark.llm.queries import QUERIES

    names = ["p2_found", "p3_found", "p5_found", "p7_found", "p8_found"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, QUERIES[name](spark, sf).collect())) for name in names])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] and all(results[0])
