"""Databases behind a client: one shape of statements and answers, and reads in parallel ranges.

A client is a DB-API connection, or anything with ``query`` or ``execute``. Spark
reads through JDBC (see :mod:`shardloom.sources.connectors`) or, where there is a
Python driver alone, through :func:`read_database`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shardloom.errors import EngineError
from shardloom.functions.idents import check_arity, numbered, outside, quote

#: How a client's driver marks values: as they are given (?), numbered ($1), or as format codes (%s).
STYLES: dict[str, Callable[[str], str]] = {
    "qmark": str,
    "numeric": numbered,
    "format": lambda sql: outside(sql, lambda t: t.replace("%", "%%").replace("?", "%s"), lambda t: t.replace("%", "%%")),
}
#: Rows that are fetched at once.
FETCH = 10_000


@dataclass
class Answer:
    """Rows as dicts; for changes how many rows they affected and the id that was generated last."""

    rows: list[dict] = field(default_factory=list)
    changes: int = 0
    last_id: Any = None


@runtime_checkable
class SQLDatabase(Protocol):
    def run(self, sql: str, args: list | tuple = ()) -> Answer: ...
    def all(self, sql: str, args: list | tuple = ()) -> list[dict]: ...
    def first(self, sql: str, args: list | tuple = ()) -> dict | None: ...


def is_sql_database(x: Any) -> bool:
    return isinstance(x, SQLDatabase)


class ClientDatabase:
    """A client under the common shape."""

    def __init__(self, client: Any, style: str = "qmark"):
        if style not in STYLES:
            raise EngineError(f"Unknown placeholder style {style!r}", "INVALID_QUERY_INPUT")
        self.client, self.style = client, style
        self._send = next((f for name, f in (("cursor", self._cursor), ("query", self._call), ("execute", self._call)) if callable(getattr(client, name, None))), None)
        if self._send is None:
            raise EngineError("client has no cursor, query or execute", "NO_SHARDS")

    def run(self, sql: str, args: list | tuple = ()) -> Answer:
        check_arity(sql, args)
        return self._send(STYLES[self.style](sql), tuple(args))

    def all(self, sql: str, args: list | tuple = ()) -> list[dict]:
        return self.run(sql, args).rows

    def first(self, sql: str, args: list | tuple = ()) -> dict | None:
        return next(iter(self.all(sql, args)), None)

    def _cursor(self, sql: str, args: tuple) -> Answer:
        cursor = self.client.cursor()
        try:
            cursor.execute(sql, args)
            if cursor.description:
                names = [c[0] for c in cursor.description]
                return Answer([dict(zip(names, r, strict=True)) for r in cursor.fetchall()])
            self.client.commit()
            return Answer([], max(0, cursor.rowcount), cursor.lastrowid)
        finally:
            cursor.close()

    def _call(self, sql: str, args: tuple) -> Answer:
        call = getattr(self.client, "query", None) or self.client.execute
        return answer(call(sql, list(args)))


def answer(out: Any) -> Answer:
    """What a client returned: rows; rows with their fields; an object with rows; or the summary of a change."""
    if isinstance(out, tuple):
        out = out[0]
    if out is None:
        return Answer()
    if isinstance(out, list):
        return Answer([dict(r) for r in out])
    if not isinstance(out, dict):
        raise EngineError(f"{type(out).__name__} is no answer of a database", "QUERY_FAILED")
    rows = [dict(r) for r in out.get("rows") or out.get("results") or []]
    first = lambda *names: next((out[n] for n in names if out.get(n) is not None), None)
    return Answer(rows, 0 if rows else first("changes", "affectedRows", "rowCount") or 0, first("last_id", "insertId", "lastInsertRowid"))


def read_database(spark: SparkSession, connect: Callable[[], Any], table: str, schema: StructType | str, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table through a DB-API driver that every executor has; ``connect`` is sent along and called there.

    ``split`` (whole-number column, lower, upper, parts): that many ranges, each read by a task
    of its own; values beyond the bounds, and nulls, go to the first and the last.
    """
    schema = spark.createDataFrame([], schema).schema
    names, kind = ", ".join(quote(f.name).replace("`", '"') for f in schema.fields), to_arrow_schema(schema)
    asked = f'SELECT {names} FROM {quote(table).replace("`", chr(34))}'
    where = [""]
    if split:
        column, low, high, parts = split
        column, step = quote(column).replace("`", '"'), max(1, -(-(high - low + 1) // parts))
        cuts = [low + step * k for k in range(1, parts)]
        where = [f" WHERE {column} < {cuts[0]} OR {column} IS NULL", *(f" WHERE {column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f" WHERE {column} >= {cuts[-1]}"] if cuts else where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                client = connect()
                try:
                    cursor = client.cursor()
                    cursor.execute(asked + where[k])
                    while rows := cursor.fetchmany(FETCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                finally:
                    client.close()

    return spark.range(0, len(where), 1, len(where)).mapInArrow(run, schema)
