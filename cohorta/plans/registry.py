"""Driver query registry: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            from cohorta.session import apply_conf
            apply_conf(spark)  # UTC, dynamic overwrite, AQE: the operators rely on them
            return _fn(spark, sf_dir)
        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco
