"""Writing tables: copy-on-write inserts, updates and deletes with constraint checks.

New rows are written as a segment before they are checked, so checks read what is stored and a
source is computed once; a segment of a failed statement is never pointed to.  Updates and deletes
first find the segments that hold rows to change, with the predicate pushed to the files, and rewrite
only those; the others stay as they are.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater import catalog as C
from tidewater.catalog import ROWID, Table
from tidewater.plans.tokens import DialectError, spark_sql


def frame_of_values(session, table: Table, columns: tuple[str, ...], rows: list) -> DataFrame:
    """Literal rows as a DataFrame; expressions are evaluated in one projection over one row each."""
    names = columns or tuple(table.names())
    for r in rows:
        if len(r) != len(names):
            raise DialectError(f"Binder Error: table {table.key} expects {len(names)} values, {len(r)} were given")
    text = ", ".join("(" + ", ".join(f"cast({spark_sql(list(v))} as {table.column(n).type})" for v, n in zip(r, names, strict=True)) + ")" for r in rows)
    return session.spark.sql(f"select * from values {text} as v({', '.join(f'`{n}`' for n in names)})")


def _complete(session, table: Table, columns: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """``rows`` by position in the table's columns and types, with defaults and row ids."""
    names = list(columns) or table.names()
    if len(rows.columns) != len(names):
        raise DialectError(f"Binder Error: table {table.key} expects {len(names)} columns, the source has {len(rows.columns)}")
    given = rows.toDF(*[f"v{i}" for i in range(len(names))])
    at = {n.lower(): i for i, n in enumerate(names)}
    out = []
    for c in table.columns:
        if c.name.lower() in at:
            value = F.col(f"v{at[c.name.lower()]}")
        else:
            value = session.expression(list(c.default), given) if c.default else F.lit(None)
        out.append(value.cast(c.type).alias(c.name))
    for n in names:
        table.column(n)
    return given.select(*out).withColumn(ROWID, F.monotonically_increasing_id() + F.lit(table.next_rowid))


def _staged(session, table: Table, rows: DataFrame) -> tuple[str, DataFrame]:
    path = session.database.write(rows, table)
    return path, table.rows_of(session.spark, (path,))


def _refuse_external(table: Table) -> None:
    if table.external is not None:
        raise DialectError(f"Binder Error: {table.key} is registered for reading only")


def insert_frame(session, table: Table, columns: tuple[str, ...], rows: DataFrame, on_conflict: str = "abort", fresh: bool = False) -> int:
    """Insert; ``on_conflict``: abort, ignore or replace.  ``fresh``: the table is new, or takes another's place."""
    _refuse_external(table)
    state, spark = session.state, session.spark
    path, new = _staged(session, table, _complete(session, table, columns, rows))
    old, kept = table.read(spark), table.segments
    keys = [] if fresh else C.unique_keys(state, table)
    if on_conflict in ("ignore", "replace") and keys:
        conflicts = []
        for key in keys:  # of new rows with one key the first stays, or the last when replacing
            names = [f"`{k}`" for k in key]
            whole = new.dropna(subset=list(key))
            rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc(ROWID) if on_conflict == "replace" else F.asc(ROWID)))
            first = whole.withColumn("nth", rank).where("nth = 1").drop("nth")
            if on_conflict == "ignore":
                first = first.join(old.select(*names), list(key), "left_anti").select(*new.columns)
            new = first.unionByName(new.join(whole.select(ROWID), ROWID, "left_anti").select(*new.columns))
        path, new = _staged(session, table, new)
        if on_conflict == "replace" and table.segments:
            located = table.located(spark)
            for key in keys:
                names = [f"`{k}`" for k in key]
                conflicts.append(located.join(new.dropna(subset=list(key)).select(*names), list(key), "left_semi").select(ROWID, "tw_segment"))
            gone = reduce(DataFrame.unionByName, conflicts)
            kept, old = _without(session, table, lambda part: part.join(gone.select(ROWID), ROWID, "left_anti"), [r[0] for r in gone.select("tw_segment").distinct().collect()])
    C.check_rows(table, new, lambda c: session.expression(list(c), new))
    if on_conflict != "ignore" and not session.deferring and not fresh:
        C.check_unique(state, table, new, old)
    if not session.deferring:
        C.check_child(spark, state, table, new, old.unionByName(new))
        if on_conflict == "replace":
            C.check_parents(spark, state, table, old.unionByName(new))
    n, last = new.agg(F.count("*"), F.max(ROWID)).first()
    session.put(replace(table, segments=(*kept, path), next_rowid=max(table.next_rowid, (last or 0) + 1)), fresh)
    return n


def _without(session, table: Table, changed, touched: list[str]) -> tuple[tuple[str, ...], DataFrame]:
    """Segments and rows of a table whose ``touched`` segments are rewritten as ``changed`` gives them."""
    own = tuple(x for x in table.segments if x.rsplit("/", 1)[-1] in set(touched))
    kept = tuple(x for x in table.segments if x not in own)
    if own:
        path, rows = _staged(session, table, changed(table.rows_of(session.spark, own)))
        kept = kept if rows.isEmpty() else (*kept, path)
    after = replace(table, segments=kept)
    return kept, after.read(session.spark)


def insert_values(session, table: Table, columns: tuple[str, ...], rows: list, on_conflict: str = "abort") -> int:
    return insert_frame(session, table, columns, frame_of_values(session, table, columns, rows), on_conflict)


def _hit(session, rows: DataFrame, predicate: list | None, args: dict):
    return F.coalesce(session.expression(predicate, rows, args).cast("boolean"), F.lit(False)) if predicate else F.lit(True)


def _touched(session, table: Table, predicate: list | None, args: dict) -> tuple[int, list[str]]:
    """Rows that the predicate takes, and the segments that hold them."""
    rows = table.located(session.spark)
    found = rows.where(_hit(session, rows, predicate, args)).groupBy("tw_segment").count().collect()
    return sum(r["count"] for r in found), [r["tw_segment"] for r in found]


def update(session, table: Table, assignments: dict[str, list], predicate: list | None, args: dict) -> int:
    """Set columns where the predicate is true."""
    _refuse_external(table)
    state, spark = session.state, session.spark
    rows = table.read(spark)  # also binds the columns where no row is hit
    values = {table.column(c).name: session.expression(v, rows, args).cast(table.column(c).type) for c, v in assignments.items()}
    _hit(session, rows, predicate, args)
    if not table.segments:
        return 0
    n, touched = _touched(session, table, predicate, args)
    if n == 0:
        return 0
    own = tuple(x for x in table.segments if x.rsplit("/", 1)[-1] in set(touched))
    untouched = replace(table, segments=tuple(x for x in table.segments if x not in own))
    marked = table.rows_of(spark, own)
    marked = marked.withColumn("tw_hit", _hit(session, marked, predicate, args))
    new = marked.select(*[F.when(F.col("tw_hit"), values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in table.names()], ROWID)
    path, stored = _staged(session, table, new)
    after = replace(untouched, segments=(*untouched.segments, path))
    C.check_rows(table, stored, lambda c: session.expression(list(c), stored))
    if not session.deferring:
        if any(set(k) & set(values) for k in C.unique_keys(state, table)):
            C.check_unique(state, table, stored, untouched.read(spark))
        if any(c.kind == "foreign key" and set(c.columns) & set(values) for c in table.constraints):
            C.check_child(spark, state, table, stored, after.read(spark))
        C.check_parents(spark, state, table, after.read(spark), set(values))
    session.put(after)
    return n


def delete(session, table: Table, predicate: list | None, args: dict) -> int:
    """Remove rows where the predicate is true, or all."""
    _refuse_external(table)
    _hit(session, table.read(session.spark), predicate, args)
    if not table.segments:
        return 0
    if predicate is None:
        n, kept = table.read(session.spark).count(), ()
    else:
        n, touched = _touched(session, table, predicate, args)
        kept, _ = _without(session, table, lambda part: part.where(~_hit(session, part, predicate, args)), touched)
    if n == 0:
        return 0
    after = replace(table, segments=kept)
    if not session.deferring:
        C.check_parents(session.spark, session.state, table, after.read(session.spark))
    session.put(after)
    return n
