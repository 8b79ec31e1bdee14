"""Vectors with large components against the query's SQL."""

import duckdb
import pytest

from sievework.llm import queries, topk


def rows(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


def test_large_components_take_part(spark):
    data = [(0, [1.0, 2.0, -1.0, 0.5]), (1, [2.0**41, 0.0, 0.0, 1.0]), (2, [-(2.0**42), 1.0, 0.0, 0.0]), (3, [0.0, 1.0, 1.0, 1.0]), (4, [3.0, 2.0**40, 0.0, 0.0]), (100, [0.0, 0.0, 3.0, 4.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", data)
    got = sorted(tuple(r) for r in topk.search(rows(spark, data)).collect())
    assert got == sorted(con.execute(queries.TOPK_SQL).fetchall()) and len(got) == 10


def test_products_near_the_limit_and_beyond(spark):
    big = [(0, [2.0**21, 2.0**21]), (1, [2.0**21 - 1, 2.0**20]), (2, [-(2.0**21), -(2.0**21) + 1])]
    want = {i: sum(int(1024 * a) * int(1024 * b) for a, b in zip(big[0][1], v)) for i, v in big[1:]}
    assert {r.vec_id: r.score for r in topk.search(rows(spark, big)).collect()} == want
    for far in (2.0**41, 2.0**60):
        with pytest.raises(Exception, match="outside the range of scores|no 64-bit integer"):
            topk.search(rows(spark, [(0, [far, 1.0]), (1, [far, 2.0])])).collect()


def test_the_session_stays_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert spark.conf.get(name) == before
