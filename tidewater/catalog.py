"""Tables as immutable versions, and the state that a transaction sees.

A table is a list of Parquet segments that are never changed: inserting adds one, updating and
deleting write a new list.  A state maps names to tables; a snapshot is a state that one keeps.
Committing checks that the tables a transaction has written are still the ones that it started from,
and swaps them in under a lock.  A database with a folder of its own writes each state as the next
version of a catalog file beside the segments, so it can be opened again, by other processes too.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import weakref
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import journal
from tidewater import messages as M

from tidewater.plans.tokens import DialectError, Token

ROWID = "rowid"


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    not_null: bool = False
    default: tuple[Token, ...] | None = None
    #: The name in the segments' files, if it was another when they were written.
    stored: str = ""

    @property
    def physical(self) -> str:
        return self.stored or self.name


@dataclass(frozen=True)
class Constraint:
    """kind: primary key, unique, check or foreign key."""

    kind: str
    columns: tuple[str, ...] = ()
    check: tuple[Token, ...] = ()
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Table:
    key: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()
    segments: tuple[str, ...] = ()
    next_rowid: int = 1
    temporary: bool = False
    external: DataFrame | None = None

    @property
    def own_name(self) -> str:
        """The name without its schema, by which expressions may qualify columns."""
        return self.key.rpartition(".")[2]

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise DialectError(M.NO_COLUMN.format(table=f"table {self.key}", column=name))

    def schema(self) -> str:
        return ", ".join([f"`{c.name}` {c.type}" for c in self.columns] + [f"{ROWID} bigint"])

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows with their row ids."""
        if self.external is not None:
            return self.external if ROWID in self.external.columns else self.external.withColumn(ROWID, F.monotonically_increasing_id())
        if not self.segments:
            return spark.createDataFrame([], self.schema()).alias(self.own_name)
        return self.rows_of(spark, self.segments)

    def rows_of(self, spark: SparkSession, segments: tuple[str, ...], *others) -> DataFrame:
        """Rows of some segments, and ``others`` of their files' metadata."""
        schema = ", ".join([f"`{c.physical}` {c.type}" for c in self.columns] + [f"{ROWID} bigint"])
        rows = spark.read.schema(schema).parquet(*segments)
        return rows.select(*[F.col(f"`{c.physical}`").alias(c.name) for c in self.columns], ROWID, *others).alias(self.own_name)

    def located(self, spark: SparkSession) -> DataFrame:
        """All rows with the name of their segment as ``tw_segment``."""
        return self.rows_of(spark, self.segments, F.regexp_extract("_metadata.file_path", r"([0-9a-f]{32})/[^/]*$", 1).alias("tw_segment"))

    def primary_key(self) -> tuple[str, ...]:
        return next((c.columns for c in self.constraints if c.kind == "primary key"), ())


@dataclass(frozen=True)
class Trigger:
    """Only described: nothing fires it."""

    name: str
    table: str
    timing: str
    event: str
    columns: tuple[str, ...] = ()
    each_row: bool = False
    condition: tuple[Token, ...] = ()
    body: tuple[Token, ...] = ()


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, tuple[Token, ...]] = field(default_factory=dict)
    schemas: frozenset[str] = frozenset({"main"})
    types: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], bool]] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def copy(self) -> State:
        return State(dict(self.tables), dict(self.views), self.schemas, dict(self.types), dict(self.indexes), dict(self.triggers))


class Database:
    """What sessions share: the committed state, the folder of the segments, and INSERT rows that are held back.

    With a folder the state outlives the process: see ``journal``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.state, self.lock, self.version = spark, State(), threading.RLock(), 0
        self._folder = folder.rstrip("/") if folder else None
        self.journal = journal.Journal(spark, f"{self._folder}/catalog") if folder else None
        self.holding: dict[int, object] = {}
        atexit.register(_flush_at_exit, weakref.ref(self))
        self.refresh()

    @property
    def folder(self) -> str:
        """The given folder, else one in the shared checkpoint folder, else, in one process, a local one."""
        if self._folder is None:
            base = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
            if not base:
                if not self.spark.sparkContext.master.startswith("local"):
                    raise ValueError("give the database a folder, or set spark.checkpoint.dir to one that driver and executors share")
                base = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
            self._folder = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        return self._folder

    def write(self, rows: DataFrame, table: Table) -> str:
        """A new segment with these rows, in the table's columns and types."""
        path = f"{self.folder}/{table.key}/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.physical) for c in table.columns], F.col(ROWID).cast("bigint").alias(ROWID)).write.parquet(path)
        return path

    def flush(self) -> None:
        """Write the INSERT rows that sessions hold back."""
        with self.lock:
            for session in list(self.holding.values()):
                session.flush()

    def refresh(self) -> None:
        """Take up what other processes have committed."""
        if self.journal is None:
            return
        with self.lock:
            newest = self.journal.newest()
            if newest > self.version:
                own = {k: t for k, t in self.state.tables.items() if t.temporary}
                self.state = journal.loads(self.journal.read(newest))
                self.state.tables.update(own)
                self.version = newest

    def commit(self, base: State, work: State) -> None:
        """Swap in what ``work`` changed since ``base``, or fail if another has changed it meanwhile."""
        with self.lock:
            while True:
                self.refresh()
                now = self._merged(base, work)
                if self.journal is None or self.journal.write(self.version + 1, journal.dumps(now)):
                    self.state, self.version = now, self.version + 1
                    return

    def _merged(self, base: State, work: State) -> State:
        now = self.state.copy()
        for part in ("tables", "views", "types", "indexes", "triggers"):
            b, w, n = getattr(base, part), getattr(work, part), getattr(now, part)
            for key in b.keys() | w.keys():
                if b.get(key) != w.get(key):
                    if n.get(key) != b.get(key):
                        raise DialectError(M.CONFLICT.format(table=key))
                    if key in w:
                        n[key] = w[key]
                    else:
                        n.pop(key, None)
        now.schemas = (now.schemas | work.schemas) - (base.schemas - work.schemas)
        return now

    def compact(self, key: str, segments: int = 1) -> int:
        """Rewrite a table's rows into one segment if it has more than ``segments``; the number it had."""
        self.flush()
        self.refresh()
        base = self.state
        table = base.tables[key]
        if len(table.segments) > segments:
            work = base.copy()
            work.tables[key] = replace(table, segments=(self.write(table.read(self.spark), table),))
            self.commit(base, work)
        return len(table.segments)

    def remove_unreferenced(self) -> int:
        """Delete segments that no table points to, such as those of old versions and failed statements.

        Only for when no other session reads an older snapshot or writes.
        """
        self.flush()
        self.refresh()
        kept = {s for t in self.state.tables.values() for s in t.segments}
        return journal.Journal(self.spark, self.folder).remove(kept)


def _flush_at_exit(database: weakref.ref) -> None:
    """Rows still held when the interpreter ends are written if Spark still runs."""
    if (own := database()) is not None and own.holding:
        with contextlib.suppress(Exception):
            own.flush()


# -- constraints ----------------------------------------------------------------------------------


def check_all(spark: SparkSession, state: State, table: Table) -> None:
    """What deferred enforcement leaves to COMMIT, of a whole table."""
    rows = table.read(spark)
    check_unique(state, table, rows)
    check_child(spark, state, table, rows, rows)
    check_parents(spark, state, table, rows)


def _any(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def check_rows(table: Table, rows: DataFrame, check_expression) -> None:
    """NOT NULL and CHECK of new or changed rows, all in one pass."""
    required = [c.name for c in table.columns if c.not_null or c.name in table.primary_key()]
    failed = [(M.NOT_NULL.format(table=table.key, column=n), F.col(f"`{n}`").isNull()) for n in required]
    failed += [(M.CHECK.format(table=table.key), ~F.coalesce(check_expression(c.check), F.lit(True))) for c in table.constraints if c.kind == "check"]
    if failed:
        found = rows.agg(*(F.max(x).alias(f"f{i}") for i, (_, x) in enumerate(failed))).first()
        for hit, (message, _) in zip(found, failed, strict=True):
            if hit:
                raise DialectError(message)


def unique_keys(state: State, table: Table) -> list[tuple[str, ...]]:
    """Column lists that must be unique: keys, UNIQUE constraints and unique indexes."""
    return [c.columns for c in table.constraints if c.kind in ("primary key", "unique")] + [cols for key, cols, unique in state.indexes.values() if unique and key == table.key]


def check_unique(state: State, table: Table, rows: DataFrame, old: DataFrame | None = None) -> None:
    """Uniqueness within ``rows`` and against ``old``, all keys in one job; keys that hold a NULL are exempt."""
    clashes = []
    for i, columns in enumerate(unique_keys(state, table)):
        names = [f"`{c}`" for c in columns]
        keyed = rows.dropna(subset=list(columns)).select(*names)
        clashes.append(keyed.groupBy(*names).count().where("count > 1").select(F.lit(i).alias("key")))
        if old is not None:
            clashes.append(keyed.join(old.select(*names), list(columns), "left_semi").select(F.lit(i).alias("key")))
    if clashes:
        found = reduce(DataFrame.unionByName, clashes).first()
        if found is not None:
            columns = unique_keys(state, table)[found.key]
            kind = "primary key" if columns == table.primary_key() else "unique"
            raise DialectError(M.DUPLICATE.format(table=table.key, columns=", ".join(columns), kind=kind))


def check_child(spark: SparkSession, state: State, table: Table, rows: DataFrame, whole: DataFrame | None = None) -> None:
    """Foreign keys of new or changed rows find their parents; ``whole``: the table as it will be, for its own keys."""
    for c in table.constraints:
        if c.kind == "foreign key":
            keys = [F.col(f"`{p}`").alias(f"k{i}") for i, p in enumerate(c.parent_columns)]
            if c.parent != table.key:
                found = state.tables[c.parent].read(spark).select(*keys)
            elif whole is not None:
                found = whole.select(*keys)
            else:
                found = state.tables[c.parent].read(spark).select(*keys).unionByName(rows.select(*keys))
            child = rows.dropna(subset=list(c.columns)).select(*[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(c.columns)])
            if _any(child.join(found, [f"k{i}" for i in range(len(keys))], "left_anti")):
                raise DialectError(M.NO_PARENT.format(table=table.key, parent=c.parent))


def check_parents(spark: SparkSession, state: State, table: Table, remaining: DataFrame, changed: set[str] | None = None) -> None:
    """Rows that refer to ``table`` still find their parents among ``remaining``; ``changed``: columns that others' keys name."""
    for child in state.tables.values():
        for c in child.constraints:
            if c.kind == "foreign key" and c.parent == table.key and (changed is None or changed & {*c.parent_columns, *(c.columns if child.key == table.key else ())}):
                rows = remaining if child.key == table.key else child.read(spark)
                on = [f"k{i}" for i in range(len(c.columns))]
                refers = rows.dropna(subset=list(c.columns)).select(*[F.col(f"`{x}`").alias(k) for x, k in zip(c.columns, on, strict=True)])
                if _any(refers.join(remaining.select(*[F.col(f"`{x}`").alias(k) for x, k in zip(c.parent_columns, on, strict=True)]), on, "left_anti")):
                    raise DialectError(M.STILL_REFERENCED.format(child=child.key, table=table.key))


# -- information schema ---------------------------------------------------------------------------


def information_schema(spark: SparkSession, state: State, name: str) -> DataFrame:
    """The view ``information_schema.<name>`` of a state."""

    def place(key: str) -> tuple[str, str]:
        schema, _, table = key.rpartition(".")
        return schema or "main", table

    named = [(k, t, i, c) for k, t in sorted(state.tables.items()) for i, c in enumerate(t.constraints)]

    def label(t: Table, i: int, c: Constraint) -> str:
        return c.name or f"{place(t.key)[1]}_{c.kind.replace(' ', '_')}_{i + 1}"

    if name == "tables":
        rows = [(*place(k), "LOCAL TEMPORARY" if t.temporary else "BASE TABLE") for k, t in sorted(state.tables.items())] + [(*place(k), "VIEW") for k in sorted(state.views)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")
    if name == "columns":
        rows = [(*place(k), c.name, i + 1, "NO" if c.not_null or c.name in t.primary_key() else "YES", c.type.upper()) for k, t in sorted(state.tables.items()) for i, c in enumerate(t.columns)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
    if name == "table_constraints":
        rows = [(label(t, i, c), *place(k), c.kind.upper()) for k, t, i, c in named]
        return spark.createDataFrame(rows, "constraint_name string, table_schema string, table_name string, constraint_type string")
    if name == "key_column_usage":
        rows = [(label(t, i, c), *place(k), x, n + 1) for k, t, i, c in named for n, x in enumerate(c.columns)]
        return spark.createDataFrame(rows, "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int")
    if name == "constraint_column_usage":
        rows = [(label(t, i, c), *place(c.parent or k), x) for k, t, i, c in named for x in (c.parent_columns or c.columns)]
        return spark.createDataFrame(rows, "constraint_name string, table_schema string, table_name string, column_name string")
    if name == "referential_constraints":
        rows = [(label(t, i, c), c.parent, "NO ACTION", "NO ACTION") for k, t, i, c in named if c.kind == "foreign key"]
        return spark.createDataFrame(rows, "constraint_name string, unique_constraint_table string, update_rule string, delete_rule string")
    if name == "triggers":  # beside those of the dialect
        rows = [(n, t.timing, t.event, ",".join(t.columns), *place(t.table)) for n, t in sorted(state.triggers.items())]
        return spark.createDataFrame(rows, "trigger_name string, action_timing string, event_manipulation string, event_columns string, event_object_schema string, event_object_table string")
    raise DialectError(f"Catalog Error: no view information_schema.{name}")


def table_info(spark: SparkSession, table: Table) -> DataFrame:
    """``pragma_table_info``: cid, name, type, notnull, dflt_value and pk of each column."""
    from tidewater.plans.tokens import render

    rows = [(i, c.name, c.type.upper(), c.not_null or c.name in table.primary_key(), render(list(c.default)) if c.default else None, c.name in table.primary_key()) for i, c in enumerate(table.columns)]
    return spark.createDataFrame(rows, "cid int, name string, type string, `notnull` boolean, dflt_value string, pk boolean")


__all__ = ["Column", "Constraint", "Database", "State", "Table", "Trigger"]
