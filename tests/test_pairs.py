"""Pairing of odd requests and responses, against the SQL of its query."""

import datetime

import duckdb

from weir.plans import traffic


def test_events_without_flow_or_time_pair_as_in_sql(spark, tmp_path):
    day = lambda n: None if n is None else datetime.datetime(2024, 1, n)
    # order 3 has no flow, orders 5 and 13 no time; of order 7's lines one has none
    orders = [(1, 1, day(1), "a"), (2, 1, day(5), "b"), (3, None, day(1), "c"), (5, 2, None, "d"), (6, 2, day(2), "e"), (7, 3, day(1), "f"), (13, 3, None, "g")]
    lines = [(1, 1, day(2), "R"), (2, 1, day(4), "N"), (3, 1, day(2), "A"), (5, 1, day(3), "R"), (5, 2, None, "N"), (6, 1, None, "A"), (7, 1, None, "R"), (7, 2, day(3), "N"), (None, 1, day(3), "N"), (99, 1, day(3), "N")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = traffic.http_pairs(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({traffic.ORACLE_SQL['http_pairs']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len(want) == len(orders)
