"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF, same_as_sql

from siftworks.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_as_sql(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = registry.entry(spark, SF)
    assert df.columns == ["rule", "severity", "count"] and df.count() > 5


def same_on_orders(spark, folder, name, keys):
    """The query against its SQL on orders of these keys; the number of rows."""
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").selectExpr("*", "0L AS o_custkey", "timestamp '1996-01-01' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    return same_as_sql(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def test_commits_that_share_seven_digits(spark, tmp_path):
    # the hashes of 48321 and 109789, and of 27733 and 52155, begin alike; of each pair the changelog names one
    assert same_on_orders(spark, tmp_path, "c12_undocumented_by_hash", [48321, 109789, 27733, 52155, 52155, 1, 3, 5]) == 3


def test_numbers_are_no_short_hashes(spark, tmp_path):
    # 1000005 and 1000011 are entries without #, with which other numbers begin
    assert same_on_orders(spark, tmp_path, "c12_undocumented_commits", [1000005, 1000011, *range(10000050, 10000060), *range(10000110, 10000120)]) == 6


def test_phrases_parted_by_any_space(spark, tmp_path):
    spaces = "\u00a0\u3000\u2003\u2028\u202f\u205f\u1680\ufeff\x0b\t\n\r\f"
    texts = ["one\u00a0two\u3000three " * 4, "".join(f"a{x}b{x}c{x}" for x in spaces), "a.b c, d " * 3, "\u00a0", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["d20_repeated_phrases"](spark, str(tmp_path))
    assert same_as_sql(df, con, ORACLES["d20_repeated_phrases"]) == 4
    assert {(r.doc_id, r.phrase): r.times for r in df.collect()} == {(0, "one two three"): 4, (1, "a b c"): 13, (1, "b c a"): 12, (1, "c a b"): 12}
