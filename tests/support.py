"""What tests share."""

DATA = "/root/testdata/sf0.001"


def normal(rows, columns):
    """Rows as sorted tuples of text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)
