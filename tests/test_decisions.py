"""The decisions query and its SQL on limits, large groups and repeated evidence."""

import duckdb
import pytest

from tidemark.catalog.verdicts import C


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Customers 1 to 10: posteriors 0.7, 0.15, 0.15 exactly; 100: 4,000 orders; 200: the same order twice."""
    at = tmp_path_factory.mktemp("orders")
    db = duckdb.connect()
    db.execute("""CREATE TABLE o AS
      SELECT j AS o_custkey, p AS o_orderpriority, row_number() OVER () AS o_orderkey,
        CASE WHEN i < 2 THEN 'P' WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus
      FROM range(1, 11) a(j), (VALUES ('a', 28), ('b', 6), ('c', 6)) b(p, n), range(280) c(i) WHERE i < n * j
      UNION ALL SELECT 100, CASE WHEN i % 10 < 7 THEN 'a' ELSE 'b' END, 100000 + i, 'F' FROM range(4000) r(i)
      UNION ALL SELECT 200, 'a', 200000, 'F' FROM range(2)""")
    db.execute(f"COPY (SELECT o_custkey::BIGINT AS o_custkey, * EXCLUDE o_custkey FROM o) TO '{at}/orders.parquet' (FORMAT parquet)")
    return str(at)


def test_decisions_agree_with_their_sql(spark, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    wanted = sorted(db.execute(C.oracles["l2_l3_decisions"]).fetchall())
    found = sorted(tuple(row) for row in C.queries["l2_l3_decisions"](spark, folder).collect())
    assert found == wanted
    status = {row[0]: row[4] for row in found}
    assert {status[str(j)] for j in range(1, 11)} == {"concluded"}
    assert status["100"] == "concluded" and status["200"] == "abstained"
