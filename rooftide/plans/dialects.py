"""Marks for what Spark and DuckDB write differently, and how each engine reads them."""

from __future__ import annotations

import re


def series(first: str, last: str) -> str:
    """One row for each whole number from ``first`` to ``last``; none if there is none."""
    return f"{{{{series|{first}|{last}}}}}"


def count_where(array: str, condition: str) -> str:
    """How many elements ``e`` of an array of structs meet a condition."""
    return f"{{{{count|{array}|{condition}}}}}"


def gathered(*columns: str) -> str:
    """An array of structs of a group's columns."""
    return f"{{{{gather|{'|'.join(columns)}}}}}"


READ = {
    "spark": {
        "series": lambda a, z: f"explode(IF({z} >= {a}, sequence({a}, {z}), array()))",
        "count": lambda x, c: f"size(filter({x}, e -> {c}))",
        "gather": lambda *c: f"collect_list(named_struct({', '.join(f'{chr(39)}{x}{chr(39)}, {x}' for x in c)}))",
    },
    "duckdb": {
        "series": lambda a, z: f"unnest(range({a}, {z} + 1))",
        "count": lambda x, c: f"len(list_filter({x}, lambda e: {c}))",
        "gather": lambda *c: f"list(struct_pack({', '.join(f'{x} := {x}' for x in c)}))",
    },
}


def read(sql: str, engine: str) -> str:
    """``sql`` with its marks as ``spark`` or ``duckdb`` writes them."""
    return re.sub(r"\{\{(\w+)\|(.*?)\}\}", lambda m: READ[engine][m[1]](*m[2].split("|")), sql, flags=re.DOTALL)
