"""Inserts, upserts, updates and deletes as plans: old rows in, new rows and affected rows out.

Every function is pure. Conditions follow SQL's three-valued logic; assignments
all see the old row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions.idents import outside


@dataclass
class Change:
    """The table after a statement, and the rows it affected (for RETURNING and the count).

    ``rest``: the rows that it left alone, None where those are all old rows. The table
    is the rest and, unless rows were deleted, the affected rows.
    """

    table: DataFrame
    affected: DataFrame
    rest: DataFrame | None = None

    def returning(self, columns: list[str] | None = None) -> DataFrame:
        return self.affected if columns is None else self.affected.selectExpr(*columns)


def matches(values: dict) -> Column:
    """AND of equalities; None means IS NULL."""
    if not values:
        raise EngineError("A condition is required", "EMPTY_WHERE")
    return reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items()])


def _aligned(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows in the table's columns and types; unknown columns are refused, missing ones are null."""
    if extra := set(new.columns) - set(old.columns):
        raise EngineError(f"Unknown columns {sorted(extra)}", "INVALID_IDENTIFIER")
    if not new.columns:
        raise EngineError("No columns to insert", "EMPTY_INSERT")
    return new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def last_of(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Of incoming rows with equal keys the last by ``order`` (else the greatest row), by aggregation."""
    rest = [c for c in new.columns if c not in keys and c != order]
    best = F.max_by(F.struct(*rest), F.struct(*([order] if order else rest))) if rest else None
    if best is None:
        return new.select(*keys).distinct()
    out = new.groupBy(*keys).agg(best.alias("_r"))
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def insert(old: DataFrame, new: DataFrame, keys: list[str], on_conflict: str = "abort", order: str | None = None) -> Change:
    """``abort``: refuse if any key is already there (nothing is inserted); ``replace``: new rows win;
    ``ignore``: old rows win. Null keys never conflict on abort, and equal each other otherwise."""
    if on_conflict == "abort":
        rows = _aligned(new if order is None or order in old.columns else new.drop(order), old)
        twice = rows.dropna(subset=keys).groupBy(*keys).count().where("count > 1")
        if not rows.join(old.select(*keys), keys, "left_semi").isEmpty() or not twice.isEmpty():
            raise EngineError("Duplicate key", "CONSTRAINT_FAILED")
        return Change(old.unionByName(rows), rows)
    rows = _aligned(last_of(new, keys, order), old)
    if on_conflict == "replace":
        rest = old.join(rows, _same(old, rows, keys), "left_anti")
        return Change(rest.unionByName(rows), rows, rest)
    if on_conflict != "ignore":
        raise EngineError(f"Unknown conflict rule {on_conflict}", "EMPTY_CONFLICT")
    fresh = rows.join(old, _same(rows, old, keys), "left_anti")
    return Change(old.unionByName(fresh), fresh)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | dict[str, str] | None = None, order: str | None = None) -> Change:
    """Insert, or where ``keys`` meet an old row update it.

    ``update``: columns taken from the new row (default: all given but the
    keys; none: do nothing), or {column: SQL} over old columns and new ones as
    ``excluded.column``. One join, whose sides are hashed by the keys; null keys meet.
    """
    if not keys:
        raise EngineError("Conflict columns are required", "EMPTY_CONFLICT")
    given = [c for c in new.columns if c != order and c not in keys]
    update = given if update is None else update
    sets = update if isinstance(update, dict) else {c: f"excluded.{c}" for c in update if c not in keys}
    if not sets:
        return insert(old, new, keys, "ignore", order)
    rows = _aligned(last_of(new, keys, order), old)
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = rows.withColumn("_new", F.lit(True)).alias("excluded")
    both = o.join(n, reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"excluded.{k}")) for k in keys]), "full_outer")
    hit, fresh = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()

    def value(f) -> Column:
        kept, taken = F.col(f"o.{f.name}"), F.col(f"excluded.{f.name}")
        own = kept if f.name not in sets else F.expr(_qualified(sets[f.name], old.columns)).cast(f.dataType)
        return F.when(fresh, taken).when(hit, own).otherwise(kept).alias(f.name)

    out = both.select(*[value(f) for f in old.schema], F.col("_new").isNotNull().alias("_hit"))
    return Change(out.drop("_hit"), out.where("_hit").drop("_hit"), out.where("not _hit").drop("_hit"))


def _qualified(sql: str, columns: list[str]) -> str:
    """Bare column names mean the old row; text in quotes is left alone, but for a column's quoted name."""
    bare = re.compile(r"(?<![\w.])(" + "|".join(map(re.escape, columns)) + r")(?![\w.]|\s*\()", re.IGNORECASE)
    named = lambda q: f"o.{q}" if q[0] == "`" and q[1:-1] in columns else q
    marked = outside(sql, lambda t: bare.sub(r"o.\1", t), named)
    return re.sub(r"(\w|`)\.o\.(?=[`\w])", r"\1.", marked)  # a qualified quoted name


def update(old: DataFrame, sets: dict[str, str | Column], where: Column | str | None = None) -> Change:
    """SET over the rows that ``where`` holds for (null does not hold; no condition: all rows)."""
    if not sets:
        raise EngineError("No columns to update", "EMPTY_UPDATE")
    cond = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    types = {f.name: f.dataType for f in old.schema}
    if unknown := set(sets) - set(types):
        raise EngineError(f"Unknown columns {sorted(unknown)}", "INVALID_IDENTIFIER")
    new = {c: (F.expr(v) if isinstance(v, str) else v).cast(types[c]) for c, v in sets.items()}
    table = old.select(*[F.when(cond, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])
    affected = old.where(cond).select(*[new[c].alias(c) if c in new else F.col(c) for c in old.columns])
    return Change(table, affected, old.where(~cond))


def delete(old: DataFrame, where: Column | str | None, everything: bool = False) -> Change:
    """Rows that ``where`` holds for go; without a condition only if ``everything`` is said."""
    if where is None:
        if not everything:
            raise EngineError("DELETE needs a condition", "EMPTY_WHERE")
        return Change(old.limit(0), old, old.limit(0))
    cond = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    return Change(old.where(~cond), old.where(cond), old.where(~cond))


def reassign(table: DataFrame, key: str, moves: DataFrame) -> DataFrame:
    """``table`` with the shards that ``moves`` (key, shard) gives to its keys; of repeated keys the largest counts."""
    m = moves.groupBy(F.col("key").alias("_k")).agg(F.max("shard").alias("_to"))
    out = table.join(m, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce("_to", "_shard").alias("_shard") if c == "_shard" else F.col(c) for c in table.columns])


def row_numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
