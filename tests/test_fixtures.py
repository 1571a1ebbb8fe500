"""The queries over generated inputs give the rows that were written down for them."""

import re

import pytest

import known_rows as fixtures


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_expected_rows(spark, name):
    sql = fixtures.ORACLES[name]
    cells = re.findall(r"\((?:'((?:[^']|'')*)'), (?:'((?:[^']|'')*)'|(NULL))\)", sql)
    expected = sorted((a.replace("''", "'"), None if null else b.replace("''", "'")) for a, b, null in cells)
    rows = fixtures.QUERIES[name](spark, "").collect()
    assert sorted(((r["item"], r["value"]) for r in rows), key=repr) == sorted(expected, key=repr)
