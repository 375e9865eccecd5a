"""Sessions: SQL text in, DataFrames and catalog changes out."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import catalog as C
from tidewater import messages as M
from tidewater.catalog import ROWID, Database, State, Table
from tidewater.plans import coerce
from tidewater.plans import rewrite as R
from tidewater.plans import tokens as T
from tidewater.plans.tokens import DialectError, Token

#: Rows of INSERT statements that are held back and written together.
INSERT_BATCH = 8192


@dataclass
class Result:
    """What a statement did: its kind, rows affected, and the rows of a query."""

    kind: str
    rows: int = 0
    frame: DataFrame | None = None


class Prepared:
    """A statement with parameters ``?``, ``?1``, ``$1`` or ``:name``."""

    def __init__(self, session: Session, text: str):
        self.session, self.text = session, text
        self.keys = R.parameters(T.tokenize(text))[1]

    def sql(self, *args, **named) -> DataFrame:
        return self.session.sql(self.text, *args, **named)

    def execute(self, *args, **named) -> Result:
        return self.session.execute(self.text, *args, **named)


class Session:
    """One connection, used by one thread at a time.

    Sessions of one ``Database`` see each other's committed changes only; INSERT rows that one holds
    back are written before another's next statement other than INSERT.
    """

    def __init__(self, spark: SparkSession, database: Database | None = None):
        self.spark = spark
        self.database = database or Database(spark)
        self.settings = {"default_null_order": "nulls_last", "constraint_enforcement_mode": "immediate", "immediate_transaction_mode": "false"}
        self.base: State | None = None
        self.work: State | None = None
        self.aborted = False
        self.external: dict[str, Table] = {}
        self.held: tuple[str, tuple[str, ...], list] | None = None
        self.uid = uuid.uuid4().hex[:12]
        self.bound: set[str] = set()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Write what is held back; an open transaction is rolled back."""
        if self.work is not None:
            self._transaction("rollback")
        self.flush()
        for view in self.bound:
            self.spark.catalog.dropTempView(view)
        self.bound.clear()

    # -- names and state --------------------------------------------------------------------------

    @property
    def state(self) -> State:
        return self.work if self.work is not None else self.database.state

    @property
    def deferring(self) -> bool:
        """Whether keys are checked at COMMIT: in a transaction, if the session is set so."""
        return self.work is not None and self.settings["constraint_enforcement_mode"] == "deferred"

    def register(self, name: str, frame: DataFrame) -> None:
        """Make a DataFrame readable as a table of this session."""
        columns = tuple(C.Column(f.name, f.dataType.simpleString()) for f in frame.schema if f.name != ROWID)
        self.external[name.lower()] = Table(name.lower(), columns, external=frame)

    def key(self, parts: list[str]) -> str:
        parts = [p.lower() for p in parts]
        return ".".join(parts[1:] if parts[0] == "main" and len(parts) > 1 else parts)

    def table(self, key: str) -> Table:
        found = self.state.tables.get(key) or self.external.get(key)
        if found is None:
            raise DialectError(M.NO_TABLE.format(table=key))
        return found

    def _name(self, tokens: list[Token], at: int) -> tuple[list[str], int]:
        if at >= len(tokens) or tokens[at].kind not in ("name", "quoted"):
            raise DialectError("Parser Error: a name is missing")
        parts, at = [tokens[at].name], at + 1
        while at + 1 < len(tokens) and tokens[at].text == ".":
            parts.append(tokens[at + 1].name)
            at += 2
        return parts, at

    def _source(self, parts: list[str], rowid: bool) -> DataFrame | None:
        key = self.key(parts)
        if parts[0].lower() == "information_schema" and len(parts) == 2:
            return C.information_schema(self.spark, self.state, parts[1].lower())
        if key in self.state.views:
            return self._query(list(self.state.views[key]))
        table = self.state.tables.get(key) or self.external.get(key)
        if table is None:
            return None
        rows = table.read(self.spark)
        return rows if rowid else rows.select(*[f"`{c}`" for c in table.names()])

    def _bind(self, tokens: list[Token]) -> list[Token]:
        """Put a temporary view of this session's snapshot for each table that the query names."""
        rowid = any(t.word == ROWID for t in tokens)
        out: list[Token] = []
        known: set[tuple[str, str]] = set()
        where: list[bool] = [False]  # by bracket depth: whether a comma is followed by a table
        expected, i = False, 0
        while i < len(tokens):
            t = tokens[i]
            if t.text == "(" and t.kind == "op":
                where.append(expected)
                out.append(t)
                i += 1
                continue
            if t.text == ")" and t.kind == "op":
                where.pop()
                expected = False
            elif t.word in ("from", "join", "table") and t.kind == "name":
                expected = True
                where[-1] = True
                out.append(t)
                i += 1
                continue
            elif t.word in ("select", "where", "group", "having", "order", "on", "limit", "union", "except", "intersect", "values"):
                expected = False
                where[-1] = False
            elif t.text == "," and where[-1]:
                expected = True
                out.append(t)
                i += 1
                continue
            if expected and t.kind in ("name", "quoted"):
                if t.word == "pragma_table_info" and tokens[i + 1].text == "(":
                    frame, parts, end = C.table_info(self.spark, self.table(self.key(tokens[i + 2].text.strip("'\"").split(".")))), ["pragma_table_info"], T.closing(tokens, i + 1) + 1
                else:
                    parts, end = self._name(tokens, i)
                    frame = self._source(parts, rowid) if end >= len(tokens) or tokens[end].text != "(" else None
                if frame is not None:
                    view = f"tidewater_{self.uid}_{hashlib.sha256('.'.join(parts).encode()).hexdigest()[:16]}"  # no other session's
                    frame.createOrReplaceTempView(view)
                    self.bound.add(view)
                    out.append(Token("quoted", f"`{view}`"))
                    if end >= len(tokens) or not (tokens[end].word == "as" or tokens[end].kind == "quoted" or tokens[end].kind == "name" and tokens[end].word not in T.STOPS | {"right", "full", "natural", "semi", "anti", "using", "indexed"}):
                        out += [Token("name", "as"), Token("quoted", f"`{parts[-1]}`")]
                    if len(parts) > 1:
                        known.add((parts[0], parts[-1]))
                    i, expected = end, False
                    continue
                expected = False
            out.append(t)
            i += 1
        for schema, name in known:  # schema.table.column reads the table's alias
            i = 0
            while i + 4 < len(out):
                if out[i].kind in ("name", "quoted") and out[i].name == schema and out[i + 1].text == "." and out[i + 2].name == name and out[i + 3].text == "." and (i == 0 or out[i - 1].text != "."):
                    del out[i : i + 2]
                i += 1
        return out

    # -- queries ----------------------------------------------------------------------------------

    def _operand_types(self, args: dict) -> Callable[[list[Token]], tuple[str, str]]:
        def types(tokens: list[Token]) -> tuple[str, str]:
            plan = self._analysed(tokens, args)[0]._jdf.queryExecution().analyzed()
            return _exposed(plan) or ("double", "double")

        return types

    def _argument_types(self, args: dict) -> Callable[[list[list[Token]], list[Token]], list[str] | None]:
        def types(arguments: list[list[Token]], source: list[Token]) -> list[str] | None:
            items: list[Token] = []
            for i, x in enumerate(arguments):
                items += [*([Token("op", ",")] if items else []), *x, *R.sql(f"as tw_{i}")]
            try:
                return [f.dataType.simpleString() for f in self._analysed([*R.sql("select"), *items, *source], args)[0].schema]
            except AnalysisException:
                return None

        return types

    def _analysed(self, tokens: list[Token], args: dict) -> tuple[DataFrame, list[Token]]:
        """The frame of Spark SQL tokens, with booleans and numbers cast to each other where needed."""
        return coerce.coerced(tokens, lambda text: self.spark.sql(text, args=args))

    def _query(self, tokens: list[Token], args: dict | None = None) -> DataFrame:
        """A query's DataFrame over the session's snapshot."""
        args = args or {}
        over_views = any(self._names_view(tokens, i) for i in range(len(tokens)))
        tokens = R.dialect(self._bind_tables_first(tokens), self.settings["default_null_order"] == "nulls_first", self.state.types)
        divided = any(t.text == "/" and t.kind == "op" for t in tokens)
        summed = any(t.kind == "total" or t.kind == "name" and t.word in ("sum", "avg") for t in tokens)
        try:
            if divided or summed:
                try:
                    tokens = self._analysed(tokens, args)[1]
                except AnalysisException as e:  # a division may change the types that are refused now
                    if not divided:
                        raise e
                if divided:
                    tokens = R.divisions(tokens, self._operand_types(args))
                if summed:
                    tokens = R.aggregates(tokens, self._argument_types(args))
            frame, tokens = self._analysed(tokens, args)
            self._same_types(tokens, args, over_views)
            return frame
        except AnalysisException as e:
            raise _translated(e) or e from e

    def _names_view(self, tokens: list[Token], i: int) -> bool:
        return tokens[i].kind in ("name", "quoted") and i > 0 and tokens[i - 1].word in ("from", "join", ",") and self.key([tokens[i].name]) in self.state.views

    def _same_types(self, tokens: list[Token], args: dict, exact: bool) -> None:
        """The sides of a set operation have the same types, or over tables at least numbers of any kind."""
        sides, at = [], 0
        while True:
            end = R.clause_end(tokens, at, ("union", "intersect", "except", "minus"))
            last = end >= len(tokens)
            sides.append(tokens[at : R.clause_end(tokens, at, ("order", "limit", "offset")) if last else end])
            if last:
                break
            at = end + 1 + (tokens[end + 1].word in ("all", "distinct"))
        if len(sides) < 2 or tokens[0].word == "with":
            return
        first = None
        for side in sides:
            kinds = [f.dataType.simpleString() for f in self._analysed(side, args)[0].schema]
            kinds = ["bigint" if k in ("tinyint", "smallint", "int") else k if exact or not k.startswith(("decimal", "float", "double")) else "number" for k in kinds]
            kinds = ["number" if k == "bigint" and not exact else k for k in kinds]
            first = first or kinds
            for i, (a, b) in enumerate(zip(first, kinds, strict=False)):
                if a != b and "void" not in (a, b):
                    raise DialectError(f"Binder Error: column {i + 1} of the set operation is {a} on one side and {b} on another")
            first = [b if a == "void" else a for a, b in zip(first, kinds, strict=False)]

    def _bind_tables_first(self, tokens: list[Token]) -> list[Token]:
        return self._bind(R.indexed_by(R.in_lists(tokens)))

    def expression(self, tokens: list[Token], rows: DataFrame, args: dict | None = None):
        """A scalar expression over ``rows``' columns as a Column; subqueries are not allowed here."""
        args = args or {}
        tokens = R.dialect(list(tokens), False, self.state.types)
        tokens = [x for t in tokens for x in (literal(args[t.text[1:]]) if t.kind == "param" else [t])]

        def analysed(probe: list[Token]) -> tuple[DataFrame, list[Token]]:
            return coerce.coerced(probe, rows.selectExpr)

        def types(probe: list[Token]) -> tuple[str, str]:
            return _exposed(analysed(probe)[0]._jdf.queryExecution().analyzed()) or ("double", "double")

        if any(t.kind == "total" or t.kind == "name" and t.word in ("sum", "avg") for t in tokens):
            tokens = R.aggregates(tokens, lambda arguments, _: [analysed(x)[0].schema[0].dataType.simpleString() for x in arguments])
        try:
            tokens = analysed(tokens)[1]
        except AnalysisException as e:
            if "/" not in [t.text for t in tokens]:
                raise _translated(e) or e from e
        return F.expr(T.spark_sql(analysed(R.divisions(tokens, types))[1] if "/" in [t.text for t in tokens] else tokens))

    def sql(self, text: str, *args, **named) -> DataFrame:
        """The DataFrame of one query; nothing is run before an action."""
        result = self.execute(text, *args, **named)
        if result.frame is None:
            raise DialectError("Binder Error: sql() takes a query; use execute()")
        return result.frame

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def execute(self, text: str, *args, **named) -> Result:
        """Run statements; the result is the last one's."""
        result = Result("empty")
        for tokens in T.statements(T.tokenize(text)):
            result = self.run(tokens, *args, **named)
        return result

    def run(self, tokens: list[Token], *args, **named) -> Result:
        """Run one statement."""
        tokens, keys = R.parameters(tokens)
        values = {f"p_{k}": named[k] if k in named else args[int(k) - 1] for k in keys if k in named or k.isdigit() and int(k) <= len(args)}
        if len(values) < len(keys):
            raise DialectError("Binder Error: a parameter has no value")
        return self._statement(tokens, values)

    # -- statements -------------------------------------------------------------------------------

    def _statement(self, tokens: list[Token], args: dict) -> Result:
        from tidewater.plans import statements

        head = tokens[0].word
        if head != "insert":
            self.database.flush()
            self.database.refresh()
        if head in ("begin", "start", "commit", "end", "rollback"):
            self.flush()
            return self._transaction(head)
        if self.aborted:
            raise DialectError(M.ABORTED)
        try:
            if head != "insert":
                self.flush()
            if head in ("select", "values", "(", "with"):
                return Result("select", frame=self._query(tokens, args))
            handler = statements.HANDLERS.get(head)
            if handler is None:
                raise DialectError(f"Binder Error: unsupported SQL statement {head.upper()}")
            return handler(self, tokens, args)
        except Exception:
            self.aborted = self.work is not None
            raise

    def _transaction(self, head: str) -> Result:
        if head in ("begin", "start"):
            if self.work is not None:
                raise DialectError("TransactionContext Error: a transaction is already open")
            self.base, self.work, self.aborted = self.database.state, self.database.state.copy(), False
            return Result("begin")
        if self.work is None:
            raise DialectError("TransactionContext Error: there is no open transaction")
        base, work, aborted = self.base, self.work, self.aborted
        self.base = self.work = None
        self.aborted = False
        if head in ("commit", "end") and not aborted:
            if self.settings["constraint_enforcement_mode"] == "deferred":
                for key, table in work.tables.items():
                    if table != base.tables.get(key):
                        C.check_all(self.spark, work, table)
            self.database.commit(base, work)
            return Result("commit")
        return Result("rollback")

    def change(self, edit: Callable[[State], None]) -> None:
        """Change the transaction's state, or the database's in a transaction of its own."""
        if self.work is not None:
            edit(self.work)
            return
        base = self.database.state
        work = base.copy()
        edit(work)
        self.database.commit(base, work)

    def put(self, table: Table, fresh: bool = False) -> None:
        """Point a name to a version of its table; ``fresh``: another table, so what belongs to the old one goes."""

        def edit(state: State) -> None:
            if fresh and table.key in state.tables:
                forget(state, table.key)
            state.tables[table.key] = table

        self.change(edit)

    def hold(self, key: str, columns: tuple[str, ...], rows: list) -> None:
        """Hold back rows of INSERT statements, up to ``INSERT_BATCH``."""
        with self.database.lock:
            if self.held is not None and self.held[:2] != (key, columns):
                self.flush()
            self.held = (key, columns, (self.held[2] if self.held else []) + rows)
            self.database.holding[id(self)] = self
            if len(self.held[2]) >= INSERT_BATCH:
                self.flush()

    def flush(self) -> int:
        """Write the rows of INSERT statements that are held back."""
        with self.database.lock:
            if self.held is None:
                return 0
            from tidewater.operators import dml

            (key, columns, rows), self.held = self.held, None
            self.database.holding.pop(id(self), None)
            return dml.insert_values(self, self.table(key), columns, rows)

    # -- fluent API -------------------------------------------------------------------------------

    def scan(self, name: str):
        from tidewater.operators.frame import Frame

        self.database.flush()
        self.database.refresh()
        rows = self._source(name.split("."), False)
        if rows is None:
            raise DialectError(M.NO_TABLE.format(table=name))
        return Frame(self, rows)

    def create_table(self, name: str):
        from tidewater.operators.frame import TableBuilder

        return TableBuilder(self, name)


def forget(state: State, key: str) -> None:
    """Take a table out of a state with its indexes and triggers."""
    state.tables.pop(key)
    for name in [n for n, (t, _, _) in state.indexes.items() if t == key]:
        state.indexes.pop(name)
    for name in [n for n, t in state.triggers.items() if t.table == key]:
        state.triggers.pop(name)


def literal(value) -> list[Token]:
    """A Python value as tokens."""
    if value is None or isinstance(value, bool):
        return [Token("name", "null" if value is None else str(value).lower())]
    if isinstance(value, float) and not math.isfinite(value):
        return R.sql(f"cast('{value}' as double)")
    if isinstance(value, (int, decimal.Decimal)):
        return [Token("number", f"{value:f}" if isinstance(value, decimal.Decimal) else str(value))]
    if isinstance(value, float):
        return R.sql(f"cast('{value!r}' as double)")
    if isinstance(value, datetime.date):
        return R.sql(f"date '{value:%Y-%m-%d}'")
    return [Token("string", "'" + str(value).replace("'", "''") + "'")]


def _translated(e: AnalysisException) -> DialectError | None:
    """The dialect's error for what Spark's analyser says."""
    condition, told = e.getCondition() or "", e.getMessageParameters() or {}
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return DialectError(M.NO_TABLE.format(table=told.get("relationName", "").replace("`", "")))
    if condition.startswith("UNRESOLVED_COLUMN"):
        *source, column = [t.name for t in T.tokenize(told.get("objectName", "``")) if t.text != "."]
        known = {x.strip("` ").split("`.`")[0] for x in told.get("proposal", "").split(",")}
        if source and source[0] not in known:
            return DialectError(M.NO_SOURCE.format(table=source[0]))
        return DialectError(M.NO_COLUMN.format(table=f"table {source[-1]}" if source else "the FROM clause", column=column))
    if condition.startswith(("INCOMPATIBLE_COLUMN_TYPE", "NUM_COLUMNS_MISMATCH")):
        return DialectError("Binder Error: the sides of a set operation differ in their columns")
    return None


def _exposed(plan) -> tuple[str, str] | None:
    """Types of the operands that ``divisions`` exposes, anywhere in an analysed plan."""

    def every(seq):
        return (seq.apply(i) for i in range(seq.size()))

    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "CreateNamedStruct":
            children = list(every(node.children()))
            if children[0].toString() == "tw_left":
                return children[1].dataType().simpleString(), children[3].dataType().simpleString()
        stack += every(node.children())
        if hasattr(node, "expressions") and "plans" in node.getClass().getName():
            stack += every(node.expressions())
        if "Subquery" in node.getClass().getSimpleName() or node.getClass().getSimpleName() in ("Exists", "ListQuery", "InSubquery"):
            try:
                stack.append(node.plan())
            except Exception:  # noqa: BLE001  the alias node of a subquery in FROM has no such member
                continue
    return None


def connect(spark: SparkSession, folder: str | None = None) -> Session:
    """A session of a database: a new one, or the one of a folder."""
    return Session(spark, Database(spark, folder))


__all__ = ["Prepared", "Result", "Session", "connect", "literal"]
