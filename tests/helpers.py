"""Comparison of queries with SQL, shared by the tests."""

import math
import os

DATA = os.environ.get("PARCHMILL_TEST_DATA", "/root/testdata/sf0.001")


def plain(rows):
    """Rows as comparable tuples: numbers as floats rounded to 6 digits."""

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or isinstance(v, str):
            return v
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


def same_as_sql(spark, duck, query, sql):
    """The query's rows, columns in order of name, equal the SQL's."""
    got = query(spark, DATA)
    names = sorted(got.columns)
    relation = duck.execute(sql)
    expected_names = [d[0] for d in relation.description]
    assert names == sorted(expected_names)
    order = [expected_names.index(n) for n in names]
    expected = [tuple(r[i] for i in order) for r in relation.fetchall()]
    actual = [tuple(r) for r in got.select(*names).collect()]
    assert plain(actual) == plain(expected)
