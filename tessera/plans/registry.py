"""How a module of plans registers its queries with the SQL that they are held against."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, also: tuple[str, ...] = ()):
        """also: other names of the same query."""
        def put(f):
            for name in (f.__name__, *also):
                self.queries[name] = f
                if sql:
                    self.oracle[name] = sql
            return f

        return put
