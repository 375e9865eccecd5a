"""The fluent API: lazy frames over tables, table builders and row inserts."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.catalog import ROWID
from tidewater.plans import tokens as T
from tidewater.plans.tokens import DialectError


@dataclass(frozen=True)
class JoinOptions:
    """How a join is run; Spark chooses what is left open.

    ``algorithm``: hash or merge, for the right side as the built one.  A hash join whose right side
    Spark estimates above ``memory_limit_bytes`` is a merge join, which spills.  ``batch_size``: rows of
    a batch of ``join_stream``.  How many tasks run at once is the cluster's.
    """

    algorithm: str | None = None
    batch_size: int = 8192
    memory_limit_bytes: int | None = None

    def hinted(self, right: DataFrame) -> DataFrame:
        if self.algorithm is None:
            return right
        if self.algorithm not in ("hash", "merge"):
            raise DialectError("Binder Error: a join's algorithm is hash or merge")
        size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if self.memory_limit_bytes is not None else 0
        return right.hint("merge" if self.algorithm == "merge" or size > (self.memory_limit_bytes or 0) and self.memory_limit_bytes is not None else "shuffle_hash")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Frame:
    """A lazy frame: each step adds to the plan, ``collect`` runs it."""

    def __init__(self, session, frame: DataFrame):
        self.session, self.frame = session, frame

    def _expression(self, e: Column | str) -> Column:
        return self.session.expression(T.tokenize(e), self.frame) if isinstance(e, str) else e

    def filter(self, predicate: Column | str) -> Frame:
        return Frame(self.session, self.frame.where(self._expression(predicate)))

    def select(self, **columns: Column | str) -> Frame:
        """Computed columns by name."""
        return Frame(self.session, self.frame.select(*[self._expression(e).alias(n) for n, e in columns.items()]))

    def select_columns(self, *names: str) -> Frame:
        return Frame(self.session, self.frame.select(*names))

    def select_all(self) -> Frame:
        return self

    def aggregate(self, by: list[str] | None = None, **aggregates: Column | str) -> Frame:
        values = [self._expression(e).alias(n) for n, e in aggregates.items()]
        return Frame(self.session, self.frame.groupBy(*by).agg(*values) if by else self.frame.agg(*values))

    def join(self, other: Frame, keys: list[tuple[str, str]], how: str = "inner", null_safe: bool = False, options: JoinOptions | None = None) -> Frame:
        """inner, left, semi or anti join on pairs of columns; none gives all pairs."""
        if not keys:
            return Frame(self.session, self.frame.crossJoin(other.frame))
        left, right = self.frame.alias("l"), (options.hinted(other.frame) if options else other.frame).alias("r")
        on = None
        for a, b in keys:
            x, y = F.col(f"l.{a}"), F.col(f"r.{b}")
            one = x.eqNullSafe(y) if null_safe else x == y
            on = one if on is None else on & one
        return Frame(self.session, left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how)))

    def join_stream(self, other: Frame, keys: list[tuple[str, str]], on_batch: Callable[[pa.RecordBatch], None], how: str = "inner", null_safe: bool = False, options: JoinOptions | None = None) -> None:
        """The join's rows as Arrow batches, a partition at a time on the driver."""
        options = options or JoinOptions()
        for batch in self.join(other, keys, how, null_safe, options).batches(options.batch_size):
            on_batch(batch)

    def batches(self, size: int = 8192) -> Iterator[pa.RecordBatch]:
        """The rows as Arrow batches of at most ``size``; the driver holds a partition at a time."""
        schema = self.frame.limit(0).toArrow().schema
        rows: list[dict] = []
        for row in self.frame.toLocalIterator():
            rows.append(tuple(row))
            if len(rows) >= size:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    def collect(self):
        return self.frame.toArrow()

    def collect_rows(self) -> list:
        return self.frame.collect()


class TableBuilder:
    """CREATE TABLE step by step."""

    def __init__(self, session, name: str):
        self.session, self.name, self.columns = session, name, []

    def with_column(self, name: str, kind: str) -> TableBuilder:
        self.columns.append(f"{name} {kind}")
        return self

    def with_not_null_column(self, name: str, kind: str) -> TableBuilder:
        self.columns.append(f"{name} {kind} NOT NULL")
        return self

    def finish(self) -> TableHandle:
        self.session.execute(f"CREATE TABLE {self.name} ({', '.join(self.columns)})")
        return TableHandle(self.session, self.name)


class TableHandle:
    """Inserting rows, Arrow batches and frames into a table, and scanning it."""

    def __init__(self, session, name: str):
        self.session, self.name = session, name

    def lazy(self) -> Frame:
        return self.session.scan(self.name)

    def insert_rows(self, rows: list[dict]) -> int:
        """Rows as dicts of values; missing columns take their defaults."""
        from tidewater.operators import dml

        if not rows:
            return 0
        names = tuple(rows[0])
        self.session.flush()
        table = self._table()
        schema = ", ".join(f"`{n}` {table.column(n).type}" for n in names)
        values = [tuple(_typed(r[n], table.column(n).type) for n in names) for r in rows]
        return dml.insert_frame(self.session, table, names, self.session.spark.createDataFrame(values, schema))

    def _table(self):
        return self.session.table(self.session.key(self.name.split(".")))

    def gather(self, row_ids: list[int], columns: list[str] | None = None, nulls: str = "include") -> DataFrame:
        """The rows of some row ids, in their order.

        ``nulls``: "include" gives a row of NULLs for an id that isn't there, "drop" leaves these and
        rows of NULLs only out, "error" fails if an id isn't there.
        """
        if nulls not in ("include", "drop", "error"):
            raise DialectError("Binder Error: nulls is include, drop or error")
        self.session.database.flush()
        table = self._table()
        names = [table.column(c).name for c in columns] if columns else table.names()
        asked = self.session.spark.createDataFrame(list(enumerate(row_ids)), "tw_place long, tw_id long")
        rows = table.read(self.session.spark).select(*[f"`{n}`" for n in names], F.col(ROWID).alias("tw_found"))
        rows = rows.where(F.col("tw_found").isin(list(dict.fromkeys(row_ids)))) if len(row_ids) <= 1000 else rows
        found = asked.join(rows, F.col("tw_id") == F.col("tw_found"), "left")
        if nulls == "error" and not found.where("tw_found is null").isEmpty():
            raise DialectError(f"Catalog Error: a row id is not in {table.key}")
        if nulls == "drop":
            found = found.where("tw_found is not null").dropna("all", subset=names)
        return found.orderBy("tw_place").select(*[f"`{n}`" for n in names])

    def insert_batches(self, arrow) -> int:
        """An Arrow table or batch."""
        return self.insert_lazy(Frame(self.session, self.session.spark.createDataFrame(arrow)))

    def insert_lazy(self, frame: Frame) -> int:
        from tidewater.operators import dml

        self.session.flush()
        return dml.insert_frame(self.session, self.session.table(self.session.key(self.name.split("."))), tuple(frame.frame.columns), frame.frame)


def _typed(value, kind: str):
    """A Python value as the type that a column's Spark type takes."""
    if value is None:
        return None
    if kind == "double":
        return float(value)
    if kind == "bigint":
        return int(value)
    if kind == "boolean":
        return bool(value)
    if kind.startswith("decimal"):
        scale = int(kind[8:-1].split(",")[1])
        return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-scale), decimal.ROUND_HALF_UP, decimal.Context(prec=60))
    if kind == "date" and isinstance(value, str):
        return datetime.date.fromisoformat(value)
    return str(value) if kind == "string" else value
