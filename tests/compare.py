"""Rows of a Spark result and of its SQL, in comparable form."""

from __future__ import annotations


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return bytes(v) if isinstance(v, bytearray) else v


def spark_rows(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(x) for x in row]) for row in df.select(*(f"`{c}`" for c in columns)).collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(repr([plain(r[i]) for i in at]) for r in rows)
