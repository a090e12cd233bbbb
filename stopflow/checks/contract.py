"""One column contract for both engines, so that results compare by value.

A contract is a string of ``name:type`` items. Types: ``s`` text, ``i`` integer, ``f`` double
rounded to six decimals, ``c`` coordinate rounded to nine, ``b`` boolean, ``t`` timestamp as epoch seconds, ``d`` date as text.
A trailing ``?`` replaces NULL (by -1 or the empty text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SQL = {
    "s": "CAST({c} AS VARCHAR)",
    "d": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "f": "round(CAST({c} AS DOUBLE), 6) + 0.0",
    "c": "round(CAST({c} AS DOUBLE), 9) + 0.0",
    "b": "CAST({c} AS BOOLEAN)",
    "t": "CAST(epoch({c}) AS BIGINT)",
}

_SPARK = {
    "s": "string", "d": "string", "i": "bigint", "t": "bigint", "b": "boolean", "f": "double",
    "c": "double",
}


def _items(contract: str):
    for item in contract.split():
        name, kind = item.split(":")
        yield name, kind[0], kind.endswith("?")


def apply(df: DataFrame, contract: str) -> DataFrame:
    columns = []
    for name, kind, fill in _items(contract):
        c = F.col(f"`{name}`")
        out = {
            "s": lambda: c.cast("string"),
            "d": lambda: c.cast("date").cast("string"),
            "i": lambda: c.cast("bigint"),
            "f": lambda: F.round(c.cast("double"), 6) + F.lit(0.0),
            "c": lambda: F.round(c.cast("double"), 9) + F.lit(0.0),
            "b": lambda: c.cast("boolean"),
            "t": lambda: F.unix_seconds(c),
        }[kind]()
        if fill:
            blank = "" if kind in "sd" else -1
            out = F.coalesce(out, F.lit(blank).cast(_SPARK[kind]))
        columns.append(out.alias(name))
    return df.select(*columns)


def sql(body: str, contract: str) -> str:
    columns = []
    for name, kind, fill in _items(contract):
        out = _SQL[kind].format(c=f'"{name}"')
        if fill:
            out = f"coalesce({out}, {repr('') if kind in 'sd' else -1})"
        columns.append(f'{out} AS "{name}"')
    return f"SELECT {', '.join(columns)} FROM ({body}) AS result"
