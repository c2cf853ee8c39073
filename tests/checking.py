"""What the tests share."""

import math

SMALL = "/root/testdata/sf0.001"


def same(spark_df, duck_rel) -> None:
    """The same columns and rows, whatever their order."""
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    names = sorted(spark_df.columns)
    assert names == sorted(duck_rel.columns)
    at = [duck_rel.columns.index(n) for n in names]
    mine = sorted(tuple(value(r[n]) for n in names) for r in spark_df.collect())
    other = sorted(tuple(value(r[i]) for i in at) for r in duck_rel.fetchall())
    assert mine == other


def rows_of(df) -> list[tuple]:
    """Rows in a fixed order, columns by name."""
    names = sorted(df.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())
