import hashlib

from pyspark.sql import functions as F

from segmill.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, h string, keep_id string"
ROWS = [(1, "a", "x", None), (2, "b", "x", "y"), (3, "a", None, "z"), (4, None, "x", "x"), (5, "", "x", "x"), (6, "A", "x", "x"), (7, "b" * 300_000, None, None), (8, "a", None, None)]


def expected(rows, best):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    return sorted((i, best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_groups_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert result(exact_dedup(df)) == expected(ROWS, min)
    assert result(exact_dedup(df, keep="largest")) == expected(ROWS, max)


def test_collisions_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert result(exact_dedup(df, digest=lambda c: F.unhex(F.lit("00")))) == expected(ROWS, min)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a", None, None)] * 3
    assert [r.group_size for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()] == [3, 3, 3]
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids(spark):
    rows = [(None, "a", None, None), (2, "a", None, None), (None, "b", None, None), (None, "b", None, None), (3, None, None, None)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA), keep="largest").collect()), key=str)
    assert got == sorted([(None, 2, 2, None), (2, 2, 2, True), (None, None, 2, None), (None, None, 2, None), (3, 3, 1, True)], key=str)
