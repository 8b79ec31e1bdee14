"""Queries whose keys meet only in tables larger than the smallest ones."""

import __spark_entry__ as entry


def test_suppliers_and_customers_of_one_number_are_both_added(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 500_007, 9), (2, 500_007, 5), (3, 4, 1)], "n int, o_custkey long, o_orderkey long").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(14, 3), (14, 2), (1, 8), (None, 1)], "l_suppkey long, l_orderkey long").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(8,), (1_000_001,)], "user_id long").write.parquet(f"{sf}/events.parquet")
    got = entry.queries()["append_if_absent"](spark, sf)
    assert got.columns == ["user_id", "added"]
    assert sorted(tuple(r) for r in got.collect()) == [(1_000_001, 8), (1_000_014, 2), (1_000_014, 5)]
