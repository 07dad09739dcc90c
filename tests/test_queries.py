"""Every registered query against its DuckDB SQL."""

import duckdb
import pytest

from nearfield.plans.all_queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_limbs_of_keys_beyond_five_limbs_match_sql(spark, tmp_path):
    keys = [0, 15, (1 << 20) - 1, 1 << 20, (1 << 20) + 5, 8_999_999, 8_999_999, 1 << 31, (1 << 32) + 1, (1 << 63) - 1, -1, -17, -(1 << 63), None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(SQL["pir_limb_decompose"]).fetchall()
    got = [tuple(r) for r in QUERIES["pir_limb_decompose"](spark, str(tmp_path)).collect()]
    assert len(want) == 5 * len(keys) and sorted(got, key=str) == sorted(want, key=str)
