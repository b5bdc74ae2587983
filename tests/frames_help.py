"""What tests of DataFrames share."""


def values(df, *columns):
    """The rows as tuples of the columns, in sorted order."""
    out = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(out, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))
