import pytest

from gritstone.plans.queries import ORACLES, QUERIES

from gritstone.plans.tables import table

from .oracle import differences, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) > 0
    df.collect()


def test_equal_line_numbers_in_the_order_of_the_table(spark, tmp_path):
    """Of rows that tie, the first of the table stands, in whichever file and order Spark reads them."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for i, n in enumerate((2000, 1, 6000, 1, 4000, 1)):
        rows = spark.range(n).selectExpr(f"id % {i + 1} + 1 AS l_orderkey", f"{16 + 15 * i} + 90 * (id * 7919 % 1000) AS l_partkey", "1 AS l_linenumber", "0.02D AS l_discount")
        rows.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        next((tmp_path / f"part{i}").glob("*.parquet")).rename(folder / f"{i}.parquet")
    spark.range(1, 7).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["ea"]: r["new_name"] for r in QUERIES["variable_suggestions"](spark, str(tmp_path)).collect()}
    # the first file has function 1 alone, the third 1 to 3, the fifth 1 to 5; function 4 comes with partkey 76 + 90 * 757
    assert got == {1: "size_16", 2: f"size_{(46 + 90 * 919) % 100}", 3: f"size_{(46 + 90 * 838) % 100}", 4: f"size_{(76 + 90 * 757) % 100}", 5: f"size_{(76 + 90 * 676) % 100}"}


def test_suggestions_of_any_function_against_sql(spark, tmp_path):
    """Functions that orders lacks, suggestions without a line number or a confidence: as in the SQL."""
    rows = [(1, 16, 1, 0.02), (1, 31, 2, 0.03), (7, 16, None, 0.02), (7, 46, 3, 0.01), (7, 61, None, 0.04), (8, 62, 1, 0.05), (9, 18, 2, None), (9, 21, 3, 0.07), (9, 31, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,)], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["variable_suggestions"](spark, str(tmp_path))
    assert got.filter("ea > 1").count() > 0
    assert differences(got, views(str(tmp_path)), ORACLES["variable_suggestions"]) == ""


def test_decoded_strings_compile(spark):
    """Generated code that does not compile is otherwise passed over, and every row is interpreted."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES["decoded_strings"](spark, SF).count() > 0
        QUERIES["decoded_strings"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
