"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from leafmill.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    result = duck.execute(SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    place = [theirs.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(str(tuple(r[i] for i in place)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_every_check_in_one_bucket(spark):
    from leafmill.plans import catalogue, report_queries

    accounts = report_queries.accounts(spark, SMALL)
    per_file = accounts.groupBy("file").count().select("count").distinct().collect()
    assert [r[0] for r in per_file] == [106] and accounts.select("file", "test_id").distinct().count() == accounts.count()
    assert len(catalogue.entries()) == 259


def test_paginate_rows_takes_all_orders(spark, duck):
    rows = duck.execute("SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey ORDER BY o_orderkey, l_linenumber").fetchall()
    keys = [k for (k,) in rows]
    pages = [keys[at : at + 40] for at in range(0, len(keys), 40)]
    want = [(i + 1, len(p), p[0], len(pages)) for i, p in enumerate(pages)]
    assert sorted(map(tuple, QUERIES["paginate_rows"](spark, SMALL).select("page", "line_count", "first_order", "pages").collect())) == want


def test_paginate_rows_over_several_ranges(spark, tmp_path):
    from leafmill.plans import relational_queries

    keys = [k for k in range(1, 3 * relational_queries.ORDERS_A_RANGE, 1000) for _ in range(3)]
    spark.range(0, 3 * relational_queries.ORDERS_A_RANGE).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = [keys[at : at + 40] for at in range(0, len(keys), 40)]
    want = [(i + 1, len(p), p[0], len(pages)) for i, p in enumerate(pages)]
    assert sorted(map(tuple, QUERIES["paginate_rows"](spark, str(tmp_path)).select("page", "line_count", "first_order", "pages").collect())) == want


def test_symbols_of_all_rows(spark, duck):
    from leafmill.functions import barcodes

    middle = "/root/testdata/sf0.01"
    left = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()

    def ean13(key):
        code = f"{key:012d}"
        code += str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(code)) % 10)
        right = "".join("".join("10"[int(b)] for b in left[int(c)]) for c in code[7:])
        return "101" + "".join(left[int(c)] for c in code[1:7]) + "01010" + right + "101"

    parts = [k for (k,) in duck.execute(f"SELECT p_partkey FROM '{middle}/part.parquet'").fetchall()]
    assert len(parts) > 300
    assert sorted(map(tuple, QUERIES["ean13_modules"](spark, middle).select("p_partkey", "modules").collect())) == sorted((k, ean13(k)) for k in parts)
    orders = [k for (k,) in duck.execute("SELECT o_orderkey FROM orders").fetchall()]
    found = QUERIES["itf_symbol"](spark, SMALL).collect()
    assert max(orders) > 400 and sorted(r.o_orderkey for r in found) == sorted(orders)
    assert all(r.runs == "".join(map(str, barcodes.itf_runs(f"{r.o_orderkey:014d}"))) for r in found)


def test_table_autowidth_takes_all_words(spark, tmp_path):
    rows = [("red", "B#1", "tin cold-rolled"), ("a lengthier name", "B", "x"), (None, "", None)]
    spark.createDataFrame(rows, "p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["table_autowidth"](spark, str(tmp_path)).select("col", "widest", "longest_word", "share").collect()
    assert sorted(map(tuple, found)) == [("brand", 3, 3, 88), ("name", 16, 9, 470), ("type", 15, 11, 441)]


def test_outline_visible_beyond_a_million_rows(spark, tmp_path):
    spark.createDataFrame([(0, 5), (1, 5), (1, 6), (2, None)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(5,), (6,)], "r_regionkey int").write.parquet(f"{tmp_path}/region.parquet")
    key = "CAST(CASE id % 4 WHEN 3 THEN NULL ELSE id % 4 END AS INT) AS c_nationkey"
    spark.range(800_000).selectExpr("id AS c_custkey", key).write.parquet(f"{tmp_path}/customer.parquet")
    each = 200_000
    want = {"n0": each, "n1": each, "n2": each, "r5": 2 + 2 * each, "r6": 1 + each, None: 1 + 2 * each}  # no nation, no region
    assert {r.node: r.descendants for r in QUERIES["outline_visible"](spark, str(tmp_path)).collect()} == want


def test_width_mismatch_adds_lines_in_file_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    orders, prices = range(500), [1e16, 1.0, -1e16, 3.5]  # in pairs they make 4
    lines = [(k, p) for p in prices for k in orders]
    half = len(lines) // 2
    pq.write_table(pa.table({"l_orderkey": [k for k, _ in lines], "l_extendedprice": [p for _, p in lines]}), f"{tmp_path}/lineitem.parquet", row_group_size=half)
    pq.write_table(pa.table({"o_orderkey": list(orders), "o_totalprice": [10.0] * len(orders)}), f"{tmp_path}/orders.parquet")
    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    for name in ("orders", "lineitem"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(connection.execute(SQL["width_mismatch"]).fetchall())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in kept:
            spark.conf.set(key, "1000")
        found = sorted(map(tuple, QUERIES["width_mismatch"](spark, str(tmp_path)).select("o_orderkey", "difference").collect()))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert found == want == [(k, 7) for k in orders]
