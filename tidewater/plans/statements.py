"""Statements other than queries: parsing their heads and changing the catalog."""

from __future__ import annotations

from dataclasses import replace

from tidewater import catalog as C
from tidewater import messages as M
from tidewater.catalog import Column, Constraint, Table, Trigger
from tidewater.operators import dml
from tidewater.plans import tokens as T
from tidewater.plans.tokens import DialectError, Token
from tidewater.types import spark_type, stored_type, type_end


class Reader:
    """A place in a statement's tokens."""

    def __init__(self, tokens: list[Token], at: int = 0):
        self.tokens, self.at = tokens, at

    def peek(self, *words: str) -> bool:
        """Whether these words come next."""
        return [t.word for t in self.tokens[self.at : self.at + len(words)]] == list(words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise DialectError(f"Parser Error: expected {' '.join(words).upper()}")

    def name(self) -> list[str]:
        if self.at >= len(self.tokens) or self.tokens[self.at].kind not in ("name", "quoted"):
            raise DialectError("Parser Error: a name is missing")
        parts = [self.tokens[self.at].name]
        self.at += 1
        while self.at + 1 < len(self.tokens) and self.tokens[self.at].text == ".":
            parts.append(self.tokens[self.at + 1].name)
            self.at += 2
        return parts

    def display(self) -> str:
        """One name with its case as written."""
        t = self.tokens[self.at]
        self.at += 1
        return t.text[1:-1] if t.kind == "quoted" else t.text

    def brackets(self) -> list[Token]:
        """The tokens inside the brackets that open here."""
        if not self.peek("("):
            raise DialectError("Parser Error: expected (")
        end = T.closing(self.tokens, self.at)
        inner = self.tokens[self.at + 1 : end]
        self.at = end + 1
        return inner

    def names(self) -> tuple[str, ...]:
        return tuple(part[0].name for part in T.split(self.brackets()))

    def rest(self) -> list[Token]:
        out, self.at = self.tokens[self.at :], len(self.tokens)
        return out

    def until(self, *words: str) -> list[Token]:
        depth, begin = 0, self.at
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            if t.kind == "op":
                depth += t.text in ("(", "[", "{")
                depth -= t.text in (")", "]", "}")
            if depth == 0 and t.word in words:
                break
            self.at += 1
        return self.tokens[begin : self.at]

    @property
    def over(self) -> bool:
        return self.at >= len(self.tokens)

    def end(self) -> None:
        if not self.over:
            raise DialectError(f"Binder Error: unsupported clause {T.render(self.tokens[self.at :])}")


def forget(state, key: str) -> None:
    from tidewater import session

    session.forget(state, key)


def _result(kind: str, rows: int = 0):
    from tidewater.session import Result

    return Result(kind, rows)


# -- DDL ------------------------------------------------------------------------------------------


def _references(r: Reader, columns: tuple[str, ...], name: str, session) -> Constraint:
    parent = session.key(r.name())
    parents = r.names() if r.peek("(") else ()
    while r.take("on"):
        if not (r.take("delete") or r.take("update")):
            raise DialectError("Parser Error: expected DELETE or UPDATE")
        if not (r.take("no", "action") or r.take("restrict")):
            raise DialectError("Binder Error: only NO ACTION and RESTRICT are supported")
    return Constraint("foreign key", columns, parent=parent, parent_columns=parents, name=name)


def _definitions(parts: list[list[Token]], session) -> tuple[list[Column], list[Constraint]]:
    columns: list[Column] = []
    constraints: list[Constraint] = []
    for part in parts:
        r = Reader(part)
        name = ""
        if r.take("constraint"):
            name = r.display()
        if r.take("primary", "key"):
            constraints.append(Constraint("primary key", r.names(), name=name))
        elif r.peek("unique", "("):
            r.take("unique")
            constraints.append(Constraint("unique", r.names(), name=name))
        elif r.peek("check", "("):
            r.take("check")
            constraints.append(Constraint("check", check=tuple(r.brackets()), name=name))
        elif r.take("foreign", "key"):
            own = r.names()
            r.need("references")
            constraints.append(_references(r, own, name, session))
        else:
            column = r.display()
            end = type_end(part, r.at)
            kind = spark_type(part[r.at : end], session.state.types)
            r.at, required, default = end, False, None
            while not r.over:
                label = r.display() if r.take("constraint") else ""
                if r.take("primary", "key"):
                    constraints.append(Constraint("primary key", (column.lower(),), name=label))
                elif r.take("unique"):
                    constraints.append(Constraint("unique", (column.lower(),), name=label))
                elif r.take("not", "null"):
                    required = True
                elif r.take("null"):
                    pass
                elif r.take("check"):
                    constraints.append(Constraint("check", check=tuple(r.brackets()), name=label))
                elif r.take("references"):
                    constraints.append(_references(r, (column.lower(),), label, session))
                elif r.take("default"):
                    begin = r.at
                    r.at = T.primary_after(part, begin)
                    default = tuple(part[begin : r.at])
                else:
                    r.end()
            columns.append(Column(column, kind, required, default))
        r.end()
    return columns, constraints


def _resolved(session, table: Table) -> Table:
    """Constraints with the table's own spelling of columns, and their parents checked."""
    lower = {c.name.lower(): c.name for c in table.columns}
    if len(lower) < len(table.columns):
        raise DialectError(f"Catalog Error: duplicate column in {table.key}")
    out = []
    for c in table.constraints:
        for name in c.columns:
            table.column(name)
        if c.kind == "check":
            _check_condition(session, table, c)
        c = replace(c, columns=tuple(lower[x] for x in c.columns))
        if c.kind == "foreign key":
            parent = table if c.parent == table.key else session.state.tables.get(c.parent)
            if c.parent in session.state.views:
                raise DialectError(M.PARENT_IS_VIEW)
            if parent is None:
                raise DialectError(M.NO_TABLE.format(table=c.parent))
            columns = tuple(parent.column(x).name for x in c.parent_columns) or tuple(lower[x] if parent is table else x for x in parent.primary_key())
            keys = [set(x.lower() for x in k.columns) for k in (table.constraints if parent is table else parent.constraints) if k.kind in ("primary key", "unique")]
            keys += [set(x.lower() for x in cols) for t, cols, unique in session.state.indexes.values() if unique and t == parent.key]
            if len(columns) != len(c.columns) or {x.lower() for x in columns} not in keys:
                raise DialectError(f"Binder Error: a foreign key must refer to a primary key or unique columns of {c.parent}")
            c = replace(c, parent_columns=columns)
        out.append(c)
    if sum(c.kind == "primary key" for c in out) > 1:
        raise DialectError(f"Parser Error: table {table.key} has more than one primary key")
    return replace(table, constraints=tuple(out))


AGGREGATES = {"sum", "avg", "min", "max", "count", "total", "group_concat"}


def _check_condition(session, table: Table, c: Constraint) -> None:
    """A CHECK reads the row's own columns only."""
    if any(t.word == "select" or t.word in AGGREGATES and n.text == "(" for t, n in zip(c.check, (*c.check[1:], Token("op", "")), strict=True)):
        raise DialectError("Binder Error: a CHECK holds neither subqueries nor aggregates")
    session.expression(list(c.check), replace(table, segments=()).read(session.spark))


def _create(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    or_replace = r.take("or", "replace")
    temporary = r.take("temp") or r.take("temporary")
    if r.take("table"):
        lenient = r.take("if", "not", "exists")
        parts = r.name()
        key = session.key(parts)
        if len(parts) > 1 and parts[0] not in session.state.schemas:
            raise DialectError(f"Catalog Error: Schema with name {parts[0]} does not exist")
        if key in session.state.views:
            raise DialectError(f"Catalog Error: {key} is a view")
        if key in session.state.tables:
            if lenient and not or_replace:
                return _result("create table")
            if not or_replace:
                raise DialectError(M.TABLE_EXISTS.format(table=key))
            _unreferenced(session, key)
        if r.take("as"):
            query = r.rest()
            frame = _range(session, query)
            frame = session._query(query, args) if frame is None else frame
            columns = tuple(Column(f.name, stored_type(f.dataType.simpleString())) for f in frame.schema)
            if len({c.name.lower() for c in columns}) < len(columns):
                raise DialectError(f"Catalog Error: duplicate column in {key}")
            # the rows are written before the name points to them, so a failure leaves what was there
            return _result("create table", dml.insert_frame(session, Table(key, columns, temporary=temporary), (), frame, fresh=True))
        columns, constraints = _definitions([p for p in T.split(r.brackets()) if p], session)
        r.end()
        if not columns:
            raise DialectError("Parser Error: a table needs columns")
        session.put(_resolved(session, Table(key, tuple(columns), tuple(constraints), temporary=temporary)), fresh=True)
        return _result("create table")
    if r.take("view"):
        if or_replace:
            raise DialectError("Binder Error: CREATE OR REPLACE VIEW is not supported")
        lenient = r.take("if", "not", "exists")
        key = session.key(r.name())
        if key in session.state.views or key in session.state.tables:
            if lenient:
                return _result("create view")
            raise DialectError(f"Catalog Error: {key} already exists")
        r.need("as")
        query = r.rest()
        session._query(query)
        session.change(lambda s: s.views.__setitem__(key, tuple(query)))
        return _result("create view")
    if r.take("schema"):
        lenient = r.take("if", "not", "exists")
        name = r.name()[0]
        if name in session.state.schemas and not lenient:
            raise DialectError(f"Catalog Error: Schema with name {name} already exists")
        session.change(lambda s: setattr(s, "schemas", s.schemas | {name}))
        return _result("create schema")
    if r.take("type") or r.take("domain"):
        name = r.name()[0]
        r.need("as")
        kind = spark_type(r.rest(), session.state.types)
        if name in session.state.types:
            raise DialectError(f"Catalog Error: Type with name {name} already exists")
        session.change(lambda s: s.types.__setitem__(name, kind))
        return _result("create type")
    unique = r.take("unique")
    if r.take("index"):
        lenient = r.take("if", "not", "exists")
        name = r.name()[-1]
        r.need("on")
        table = session.table(session.key(r.name()))
        columns = tuple(table.column(part[0].name).name for part in T.split(r.brackets()))
        if name in session.state.indexes:
            if lenient:
                return _result("create index")
            raise DialectError(f"Catalog Error: Index with name {name} already exists")
        session.change(lambda s: s.indexes.__setitem__(name, (table.key, columns, unique)))
        if unique:
            try:
                C.check_unique(session.state, table, table.read(session.spark))
            except DialectError:
                session.change(lambda s: s.indexes.pop(name))
                raise
        return _result("create index")
    if r.take("trigger"):
        lenient = r.take("if", "not", "exists")
        trigger = _trigger(session, r)
        if trigger.name in session.state.triggers:
            if lenient:
                return _result("create trigger")
            raise DialectError(f"Catalog Error: Trigger with name {trigger.name} already exists")
        session.change(lambda s: s.triggers.__setitem__(trigger.name, trigger))
        return _result("create trigger")
    raise DialectError(f"Binder Error: unsupported statement {T.render(tokens[:3])}")


def _trigger(session, r: Reader) -> Trigger:
    """``name [BEFORE | AFTER | INSTEAD OF] event ON table [FOR EACH ROW] [WHEN (x)] BEGIN ... END``.

    Without a word for the time it is BEFORE.
    """
    name = r.name()[-1]
    timing = "BEFORE"
    for words in (("before",), ("after",), ("instead", "of")):
        if r.take(*words):
            timing = " ".join(words).upper()
    event, columns = r.display().upper(), ()
    if event not in ("INSERT", "UPDATE", "DELETE"):
        raise DialectError(f"Parser Error: {event} is no event of a trigger")
    if event == "UPDATE" and r.take("of"):
        columns = tuple(part[0].name for part in T.split(r.until("on")))
    if r.peek("or"):
        raise DialectError("Binder Error: a trigger has one event")
    r.need("on")
    key = session.key(r.name())
    if key not in session.state.tables and not (timing == "INSTEAD OF" and key in session.state.views):
        raise DialectError(M.NO_TABLE.format(table=key))
    for c in columns:
        session.table(key).column(c)
    each_row = r.take("for", "each", "row")
    if r.take("for", "each", "statement"):
        raise DialectError("Binder Error: triggers are for each row")
    condition = tuple(r.until("begin")) if r.take("when") else ()
    r.need("begin")
    body = r.rest()
    if len(body) < 2 or body[-1].word != "end":
        raise DialectError("Parser Error: a trigger's body ends with END")
    return Trigger(name, key, timing, event, columns, each_row, condition, tuple(body[:-1]))


def _unreferenced(session, key: str) -> None:
    for t in session.state.tables.values():
        if t.key != key and any(c.kind == "foreign key" and c.parent == key for c in t.constraints):
            raise DialectError(M.IS_PARENT.format(child=t.key))


def _range(session, query: list[Token]):
    """``SELECT * FROM range(n)`` in CREATE TABLE AS gives a column named range."""
    words = [t.word for t in query]
    if words[:5] == ["select", "*", "from", "range", "("] and len(query) == T.closing(query, 4) + 1:
        return session.spark.sql(f"select id as range from {T.spark_sql(query[3:])}")
    return None


def _drop(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    kind = r.display().lower()
    lenient = r.take("if", "exists")
    parts = r.name()
    key = session.key(parts)
    if kind == "table":
        if key in session.state.tables:
            _unreferenced(session, key)
            session.change(lambda s: forget(s, key))
            return _result("drop table")
    elif kind == "schema":
        if parts[0] in session.state.schemas - {"main"}:
            held = [k for k in session.state.tables if k.startswith(parts[0] + ".")]
            if held and not r.take("cascade"):
                raise DialectError(f"Catalog Error: schema {parts[0]} is not empty")

            def edit(s):
                for k in held:
                    forget(s, k)
                s.schemas = s.schemas - {parts[0]}

            session.change(edit)
            return _result("drop schema")
    else:
        part = {"view": "views", "type": "types", "domain": "types", "index": "indexes", "trigger": "triggers"}.get(kind)
        if part is None:
            raise DialectError(f"Binder Error: DROP {kind.upper()} is not supported")
        name = key if kind == "view" else parts[-1]
        if name in getattr(session.state, part):
            session.change(lambda s: getattr(s, part).pop(name))
            return _result(f"drop {kind}")
    if lenient:
        return _result(f"drop {kind}")
    raise DialectError(f"Catalog Error: {kind.capitalize()} with name {key} does not exist")


def _alter(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    r.need("table")
    lenient = r.take("if", "exists")
    key = session.key(r.name())
    if key not in session.state.tables and lenient:
        return _result("alter table")
    table = session.table(key)
    if table.external is not None:
        raise DialectError(f"Binder Error: {key} is registered for reading only")
    users = [c for t in session.state.tables.values() for c in t.constraints if c.kind == "foreign key" and (c.parent == key or t.key == key)]

    def refuse_if_used(name: str, retyped: bool = False) -> None:
        """Columns of constraints and indexes stay as they are."""
        own = [c for c in users if c.parent == key and name in c.parent_columns or c in table.constraints and name in c.columns]
        unique = [c for c in table.constraints if c.kind != "foreign key" and name in c.columns]
        if retyped and unique:
            raise DialectError(M.TYPE_OF_KEY)
        if unique and not any(name in c.columns for c in own):
            raise DialectError(M.DEPENDED_ON.format(column=name, kind="UNIQUE"))
        if own:
            raise DialectError((M.IN_FOREIGN_KEY if renamed or retyped else M.DEPENDED_ON).format(column=name, table=key, kind="FOREIGN KEY"))
        if any(t.name == name.lower() for c in table.constraints for t in c.check) or any(name in cols for t, cols, _ in session.state.indexes.values() if t == key):
            raise DialectError(M.DEPENDED_ON.format(column=name, kind="CHECK or INDEX"))

    renamed = r.peek("rename")
    if r.take("rename", "to"):
        new = session.key(r.name())
        if new in session.state.tables:
            raise DialectError(M.TABLE_EXISTS.format(table=new))
        if any(c.parent == key for c in users):
            raise DialectError(M.HAS_DEPENDENTS.format(table=key))

        def edit(s):
            s.tables.pop(key)
            s.tables[new] = replace(table, key=new)
            for name, (of, columns, unique) in list(s.indexes.items()):
                if of == key:
                    s.indexes[name] = (new, columns, unique)
            for name, trigger in list(s.triggers.items()):
                if trigger.table == key:
                    s.triggers[name] = replace(trigger, table=new)

        session.change(edit)
        return _result("alter table")
    if r.take("rename"):
        r.take("column")
        old = table.column(r.name()[0]).name
        r.need("to")
        new = r.display()
        refuse_if_used(old)
        if new.lower() in [c.name.lower() for c in table.columns if c.name != old]:
            raise DialectError(f"Catalog Error: column {new} already exists")
        r.end()
        columns = tuple(replace(c, name=new, stored=c.physical) if c.name == old else c for c in table.columns)
        session.put(replace(table, columns=columns))  # the segments keep their names
        return _result("alter table")
    if r.take("alter"):
        r.take("column")
        name = table.column(r.name()[0]).name
        r.take("set", "data")
        r.need("type")
        kind = spark_type(r.rest(), session.state.types)
        refuse_if_used(name, True)
        r.end()
        rows = table.read(session.spark)
        changed = replace(table, columns=tuple(replace(c, type=kind) if c.name == name else c for c in table.columns))
        session.put(replace(changed, segments=(session.database.write(rows, changed),)))
        return _result("alter table")
    if r.take("drop"):
        r.take("column")
        lenient = r.take("if", "exists")
        name = r.name()[0]
        if name not in [n.lower() for n in table.names()] and lenient:
            return _result("alter table")
        name = table.column(name).name
        refuse_if_used(name)
        if len(table.columns) == 1:
            raise DialectError(f"Catalog Error: column {name} is the only one")
        r.end()
        session.put(replace(table, columns=tuple(c for c in table.columns if c.name != name)))
        return _result("alter table")
    raise DialectError("Binder Error: unsupported ALTER TABLE")


# -- DML ------------------------------------------------------------------------------------------


def _insert(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    how = "abort"
    if tokens[0].word == "replace":
        how = "replace"
    elif r.take("or"):
        word = r.display().lower()
        if word not in ("replace", "ignore", "abort", "fail", "rollback"):
            raise DialectError(f"Parser Error: INSERT OR {word.upper()}")
        how = word if word in ("replace", "ignore") else "abort"
    r.need("into")
    key = session.key(r.name())
    columns = r.names() if r.peek("(") and not r.tokens[r.at + 1].word == "select" else ()
    table = session.table(key)
    if any(t.word == "returning" for t in r.tokens[r.at :]):
        raise DialectError("Binder Error: RETURNING is not supported")
    if r.take("values"):
        rows = []
        while True:
            rows.append([_bound(tuple(v), args) for v in T.split(r.brackets())])
            if not r.take(",") or r.over:  # a trailing comma is allowed
                break
        r.end()
        if how == "abort" and session.work is None and not table.constraints and not any(c.not_null for c in table.columns) and not any(k == key for k, _, _ in session.state.indexes.values()):
            dml.frame_of_values(session, table, columns, rows)  # analysed now, so errors are this statement's
            session.hold(key, columns, rows)
            return _result("insert", len(rows))
        session.flush()
        return _result("insert", dml.insert_values(session, session.table(key), columns, rows, how))
    session.flush()
    query = r.rest()
    return _result("insert", dml.insert_frame(session, session.table(key), columns, session._query(query, args), how))


def _bound(value: tuple[Token, ...], args: dict) -> tuple[Token, ...]:
    from tidewater.plans.rewrite import casts, structs
    from tidewater.session import literal

    value = [x for t in value for x in (literal(args[t.text[1:]]) if t.kind == "param" else [t])]
    return tuple(casts(structs(value), {}))


def _update(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    table = session.table(session.key(r.name()))
    if not r.peek("set"):
        r.take("as")
        r.display()
    r.need("set")
    assignments: dict[str, list[Token]] = {}
    for part in T.split(r.until("where", "from", "returning")):
        if part[0].text == "(":
            raise DialectError("Binder Error: tuple assignments are not supported")
        name = part[0].name if part[1].text == "=" else part[2].name
        if name in assignments:
            raise DialectError(f"Binder Error: column {name} is set twice")
        assignments[name] = part[next(i for i, t in enumerate(part) if t.text == "=") + 1 :]
    where = r.rest() if r.take("where") else None
    r.end()
    _no_subquery(where)
    return _result("update", dml.update(session, table, assignments, where, args))


def _delete(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    r.need("from")
    table = session.table(session.key(r.name()))
    where = r.rest() if r.take("where") else None
    r.end()
    _no_subquery(where)
    return _result("delete", dml.delete(session, table, where, args))


def _no_subquery(where: list[Token] | None) -> None:
    if where and any(t.word == "select" for t in where):
        raise DialectError("Binder Error: subqueries are not supported in the WHERE of UPDATE and DELETE")
    if where and any(t.word in ("returning", "using", "limit") for t in where):
        raise DialectError("Binder Error: unsupported clause")


def _truncate(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    r.take("table")
    return _result("truncate", dml.delete(session, session.table(session.key(r.name())), None, args))


# -- session --------------------------------------------------------------------------------------


def _set(session, tokens: list[Token], args: dict):
    name, value = tokens[1].name, "".join(t.text for t in tokens[2:] if t.text not in ("=", "to")).strip("'\"").lower()
    if name.lower() not in session.settings:
        raise DialectError(f"Catalog Error: unknown setting {name}")
    if name == "constraint_enforcement_mode" and value not in ("immediate", "deferred"):
        raise DialectError(f"Binder Error: {name} is immediate or deferred")
    if name == "immediate_transaction_mode":
        if value not in ("true", "false", "on", "off", "1", "0"):
            raise DialectError(f"Binder Error: {name} is on or off")
        value = str(value in ("true", "on", "1")).lower()
    if name == "default_null_order":
        value = {"nulls_first": "nulls_first", "nullsfirst": "nulls_first", "nulls first": "nulls_first"}.get(value, "nulls_last")
    session.settings[name] = value
    return _result("set")


def _pragma(session, tokens: list[Token], args: dict):
    if tokens[1].word not in ("enable_verification", "disable_verification"):
        raise DialectError(f"Catalog Error: unknown pragma {tokens[1].text}")
    return _result("pragma")


def _vacuum(session, tokens: list[Token], args: dict):
    r = Reader(tokens, 1)
    if tokens[0].word == "vacuum" and not r.take("reindex"):
        raise DialectError("Binder Error: VACUUM is not supported")
    name = r.name()[-1]
    if name not in session.state.indexes:
        raise DialectError(f"Catalog Error: Index with name {name} does not exist")
    return _result("reindex")


HANDLERS = {
    "create": _create, "drop": _drop, "alter": _alter, "insert": _insert, "replace": _insert, "update": _update, "delete": _delete,
    "truncate": _truncate, "set": _set, "pragma": _pragma, "vacuum": _vacuum, "reindex": _vacuum,
}
