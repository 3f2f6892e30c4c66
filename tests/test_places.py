"""Lines beyond the thousandth of a page share their places with the next page's: results against the SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["heading_tree", "contained_characters", "substantial_headings", "toc_range"])
def test_pages_of_many_lines(spark, tmp_path, name):
    rows = [(d, "\n".join("x" * (k * 7 % 11) for k in range({0: 2100, 1: 1003, 2: 3, 20: 1}.get(d, d % 5 + 1))), "en", "s", 0) for d in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sql.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
