"""The registered queries: every operator on the test tables, with the SQL that checks it."""

from . import columns, numbers, profiles, quality, rows, runs, shapes, texts

MODULES = (rows, columns, numbers, texts, shapes, quality, profiles, runs)


def queries() -> dict:
    out = {}
    for m in MODULES:
        for name, (fn, _) in m.Q.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = fn
    return out


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
