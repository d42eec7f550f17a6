import math


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, int | float):
        return round(float(x), 5)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


def assert_same(df, result):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
