"""Pages that share a url: the queries give what their SQL gives."""

import duckdb
import pytest

from plumbline.plans import catalog

LINKS = '<a href="/x">x</a><a href="https://other.org/">o</a>'
PAGES = [
    (1, "https://e.com/a", f"<html lang=\"en\"><title>A</title><h1>a</h1>{LINKS}</html>"),
    (2, "https://e.com/a", f"<html><h2>a</h2>{LINKS}{LINKS}</html>"),
    (3, "https://e.com/b", f"<html>{LINKS}</html>"),
    (4, "https://e.com/c", "<html></html>"),
    # by their numbers these have a description: the same one, the same one, their own
    (15, "https://e.com/d", "<html></html>"),
    (55, "https://e.com/e", "<html></html>"),
    (16, "https://e.com/d", "<html></html>"),
    (56, "https://e.com/f", "<html></html>"),
]


@pytest.mark.parametrize("name", ["page_model", "rules_on_planted_pages"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
