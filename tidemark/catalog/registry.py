"""The registry that the catalog modules fill."""

QUERIES = {}
SQL = {}


def query(sql=None, *inputs):
    """Register a query under its function name. ``sql`` selects from the CTEs named in ``inputs``."""

    def register(fn):
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (f"WITH RECURSIVE {','.join(inputs)}\n" if inputs else "") + sql
        return fn

    return register
