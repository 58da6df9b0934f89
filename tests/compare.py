"""Two result tables as sorted lists of rows with comparable values."""

import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value if isinstance(value, (int, bool)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def same(df, con, sql):
    """Asserts that a DataFrame and a SQL text give the same rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, result.fetchall())
    assert theirs, "the SQL gives no rows, so it proves nothing"
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-5) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]
