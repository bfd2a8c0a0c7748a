import __spark_entry__ as entry
from flowspark.llm.exact_dedup import exact_dedup
from tests.oracle import connect, same


def test_query_matches_sql(spark, sf_dir):
    same(entry.queries()["op1_exact_dedup"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op1_exact_dedup"])


def test_edge_cases(spark):
    rows = [(1, "Ab", 9), (2, "aB", 9), (3, None, 9), (4, "", 9), (5, "É", 9), (6, "é", 9), (7, "x" * 300_000, 9), (8, "X" * 300_000, 9), (2, "aB", 9), (None, "ab", 9), (9, "x" * 299_999 + "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id long")  # keep_id: an extra column with a clashing name
    got = sorted(map(tuple, exact_dedup(df, filter_words=4).collect()), key=str)
    want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True), (None, 2, 4, False)]
    assert got == sorted(want, key=str)
    assert exact_dedup(df.limit(0)).count() == 0
