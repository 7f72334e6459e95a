"""Registered queries equal their SQL on small tables of cases that the test tables hold rarely or never."""

import os

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL, sorted; tables are given as SQL, and written in its order."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t, sql in tables.items():
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    theirs = sorted((tuple(r) for r in want.fetchall()), key=repr)
    return sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), key=repr), theirs


def test_citations_of_customers_without_orders(spark, tmp_path):
    """Every third customer has no order; one order has no priority."""
    customer = "SELECT i::BIGINT AS c_custkey, 'n' || i AS c_name, 1 AS c_nationkey FROM range(40) t(i)"
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 40)::BIGINT AS o_custkey, CASE WHEN i <> 5 THEN '1-URGENT' END AS o_orderpriority FROM range(90) t(i) WHERE i % 40 % 3 <> 0"
    mine, theirs = both(spark, tmp_path, "citations", customer=customer, orders=orders)
    assert mine == theirs and len(mine) == 40 and sum(r[3] == "unknown" for r in mine) == 14


def test_triage_quotes_the_first_of_tied_lines(spark, tmp_path):
    """Every order has eight lines of one number and part, whose flags tell their order; the table is large enough to be dealt out to all cores."""
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 7)::BIGINT AS o_custkey, CASE i % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS o_orderstatus, (i % 5 + 1) || '-X' AS o_orderpriority FROM range(300) t(i)"
    customer = "SELECT i::BIGINT AS c_custkey, (i % 3)::INTEGER AS c_nationkey FROM range(7) t(i)"
    lineitem = "SELECT (i % 300)::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::INTEGER AS l_linenumber, 'f' || i // 300 AS l_returnflag, md5(i::VARCHAR) || md5((-i)::VARCHAR) AS l_comment FROM range(2400) t(i) ORDER BY hash(i % 300), i"
    nation = "SELECT i::INTEGER AS n_nationkey, 'N' || i AS n_name FROM range(3) t(i)"
    mine, theirs = both(spark, tmp_path, "change_triage", orders=orders, customer=customer, lineitem=lineitem, nation=nation)
    assert mine == theirs and len(mine) == 300 and {r[4] for r in mine} == {"f0"}
