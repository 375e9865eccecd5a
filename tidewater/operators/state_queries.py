"""Queries that change tables first: each runs its statements in a fresh database and returns rows.

Their DuckDB twins compute the rows that must be there afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.frame import JoinOptions
from tidewater.plans.graph import plan_graph
from tidewater.plans.tokens import DialectError
from tidewater.session import Session, connect
from tidewater.sources import csvio
from tidewater.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def script(name: str, statements: str, final: str, oracle: str, tables: tuple[str, ...] = ("customer", "nation")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = connect(spark)
        for t in tables:
            session.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        session.execute(statements)
        return session.sql(final)

    QUERIES[name], ORACLE[name] = run, oracle


COPY = "create table c (id integer primary key, name text, nation integer, balance double); insert into c select c_custkey, c_name, c_nationkey, c_acctbal from customer;"
SAME = "select c_custkey as id, c_name as name, c_nationkey as nation, c_acctbal as balance from customer"

script("ctas", "create table c as select c_custkey as id, c_nationkey as nation from customer where c_acctbal > 0", "select * from c", "select c_custkey as id, c_nationkey as nation from customer where c_acctbal > 0")
script("ctas_values", "create table v as values (1, 'a'), (2, 'b')", "select count(*) as n from v", "select 2 as n")
script("ctas_range", "create table r as select * from range(50)", "select range as k from r", "select range as k from range(50)")
script("insert_select", COPY, "select * from c", SAME)
script("insert_values", "create table v (a integer, b text default 'x'); insert into v (a) values (1), (2); insert into v values (3, 'y')", "select * from v", "select * from (values (1, 'x'), (2, 'x'), (3, 'y')) t(a, b)")
script("insert_replace", COPY + "insert or replace into c values (1, 'new', 0, 0.5), (100000000, 'other', 1, 1.5)", "select * from c", f"select * from ({SAME}) where id <> 1 union all select 1, 'new', 0, 0.5 union all select 100000000, 'other', 1, 1.5")
script("insert_ignore", COPY + "insert or ignore into c values (1, 'new', 0, 0.5), (100000000, 'other', 1, 1.5)", "select * from c", f"{SAME} union all select 100000000, 'other', 1, 1.5")
script("update_where", COPY + "update c set nation = nation + 100, name = 'rich' where balance > 5000", "select * from c", f"select id, case when balance > 5000 then 'rich' else name end as name, case when balance > 5000 then nation + 100 else nation end as nation, balance from ({SAME})")
script("update_null_predicate", COPY + "update c set name = 'hit' where nullif(nation, 3) > 2", "select id, name from c", f"select id, case when nullif(nation, 3) > 2 then 'hit' else name end as name from ({SAME})")
script("delete_where", COPY + "delete from c where nation in (1, 2, 3)", "select * from c", f"select * from ({SAME}) where nation not in (1, 2, 3)")
script("truncate", COPY + "truncate table c", "select count(*) as n from c", "select 0 as n")
script("alter_table", COPY + "alter table c rename column name to label; alter table c drop column balance; alter table c alter column nation set data type text", "select * from c", "select c_custkey as id, c_name as label, cast(c_nationkey as varchar) as nation from customer")
script("view_scan", "create view v as select c_nationkey as k, count(*) as n from customer group by c_nationkey", "select * from v where n > 2", "select c_nationkey as k, count(*) as n from customer group by c_nationkey having count(*) > 2")
script("view_union", "create view v as select c_nationkey as k from customer union select n_nationkey from nation", "select * from v", "select c_nationkey as k from customer union select n_nationkey from nation")
script("schema_names", "create schema s; create table s.c as select c_custkey as id from customer", "select s.c.id, c.id + 1 as next from s.c", "select c_custkey as id, c_custkey + 1 as next from customer")
script("type_alias", "create type money as decimal(10,2); create table m (v money); insert into m values (1.005), (2)", "select cast(sum(v) as double) as s from m", "select cast(3.01 as double) as s")
script("struct_column", "create table t (t row(t integer, u text)); insert into t values ({'t': 42, 'u': 'x'})", "select t.t.t as a, t.t.u as b from t", "select 42 as a, 'x' as b")
script("transaction_commit", COPY + "begin; delete from c where nation = 1; update c set name = 'n' where nation = 2; commit", "select * from c", f"select id, case when nation = 2 then 'n' else name end as name, nation, balance from ({SAME}) where nation <> 1")
script("transaction_rollback", COPY + "begin; delete from c; rollback", "select * from c", SAME)
script("pragma_table_info", COPY, "select cid, name, pk from pragma_table_info('c')", "select * from (values (0, 'id', true), (1, 'name', false), (2, 'nation', false), (3, 'balance', false)) t(cid, name, pk)")
script("information_schema_columns", COPY, "select column_name, ordinal_position, is_nullable from information_schema.columns where table_name = 'c'", "select * from (values ('id', 1, 'NO'), ('name', 2, 'YES'), ('nation', 3, 'YES'), ('balance', 4, 'YES')) t(column_name, ordinal_position, is_nullable)")
script("information_schema_constraints", "create table p (a integer primary key); create table q (a integer references p(a), b integer unique, check (b > 0))", "select table_name, constraint_type from information_schema.table_constraints", "select * from (values ('p', 'PRIMARY KEY'), ('q', 'FOREIGN KEY'), ('q', 'UNIQUE'), ('q', 'CHECK')) t(table_name, constraint_type)")
script("rowid_column", "create table v (a integer); insert into v values (7), (8), (9); delete from v where a = 8", "select a from v where rowid > 0", "select * from (values (7), (9)) t(a)")
PLACED = "select n_nationkey, k, row_number() over (order by {}, n_nationkey) as place from (select n_nationkey, nullif(n_regionkey, 0) as k from nation) d"
script("default_null_order", "set default_null_order = 'nulls_first'", PLACED.format("k"), PLACED.format("k asc nulls first"))
script("filter_in_table", "create table k as select n_nationkey from nation where n_regionkey = 1; create view w as select n_nationkey from nation where n_regionkey = 2", "select c_custkey from customer where c_nationkey in k or c_nationkey in w", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (1, 2))")
script("replace_table", COPY + "create or replace table c as select id + 1 as id from c", "select * from c", "select c_custkey + 1 as id from customer")
script("string_backslash", "create table b (v text); insert into b values ('a\\nb'), ('C:\\temp'), ('it''s')", "select v, v = 'C:\\temp' as same from b", "select * from (values ('a\\nb', false), ('C:\\temp', true), ('it''s', false)) t(v, same)")
script("rename_and_drop_columns", COPY + "alter table c rename column name to label; alter table c drop column balance; insert into c values (100000000, 'new', 3); update c set label = 'x' where nation = 3; alter table c rename to d", "select * from d", "select c_custkey as id, case when c_nationkey = 3 then 'x' else c_name end as label, c_nationkey as nation from customer union all select 100000000, 'x', 3")
script("deferred_fk", "create table p (a integer primary key); create table q (a integer references p(a)); set constraint_enforcement_mode = deferred; begin; insert into q select n_regionkey from nation; insert into p select distinct n_regionkey from nation; commit", "select a from q", "select n_regionkey as a from nation")
script("trigger_metadata", "create table t (a integer, b integer); create trigger log after update of a on t for each row when (new.a > 1) begin insert into t values (1, 2); update t set b = case when a = 1 then 2 else 3 end; end; create trigger plain insert on t begin delete from t; end", "select trigger_name, action_timing, event_manipulation, event_columns, event_object_table from information_schema.triggers", "select * from (values ('log', 'AFTER', 'UPDATE', 'a', 't'), ('plain', 'BEFORE', 'INSERT', '', 't')) t(trigger_name, action_timing, event_manipulation, event_columns, event_object_table)")
script("information_schema_tables", "create schema s; create table s.c (a integer); create temp table d (a integer); create view v as select * from d", "select * from information_schema.tables", "select * from (values ('s', 'c', 'BASE TABLE'), ('main', 'd', 'LOCAL TEMPORARY'), ('main', 'v', 'VIEW')) t(table_schema, table_name, table_type)")
script("information_schema_keys", "create table p (a integer, b integer, primary key (a, b)); create table q (x integer, y integer, constraint fk foreign key (x, y) references p (a, b))", "select k.table_name, k.column_name, k.ordinal_position, u.column_name as parent, r.unique_constraint_table as parents from information_schema.key_column_usage k left join information_schema.constraint_column_usage u on k.constraint_name = u.constraint_name and k.constraint_name = 'fk' and u.column_name = case when k.ordinal_position = 1 then 'a' else 'b' end left join information_schema.referential_constraints r on r.constraint_name = k.constraint_name", "select * from (values ('p', 'a', 1, null, null), ('p', 'b', 2, null, null), ('q', 'x', 1, 'a', 'p'), ('q', 'y', 2, 'b', 'p')) t(table_name, column_name, ordinal_position, parent, parents)")
script("pragma_filtered", COPY, "select name from pragma_table_info('c') where pk = 0 and cid > 1", "select * from (values ('nation'), ('balance')) t(name)")
script("insert_held", "create table v (a integer, b double); insert into v values (1, 0.5); insert into v values (2, 1.5); insert into v (b) values (2.5)", "select * from v", "select * from (values (1, 0.5::double), (2, 1.5::double), (null, 2.5::double)) t(a, b)")


def _prepared_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = connect(spark)
    session.execute("create table b (v text, d double)")
    session.prepare("insert into b values (?, ?)").execute("a\\nb's", 0.1)
    session.prepare("insert into b values (?, ?)").execute("C:\\temp", -2.5)
    return session.prepare("select v, d from b where v <> ? and length(v) < ?2").sql("\\n", 100)


QUERIES["prepared_backslash"] = _prepared_backslash
ORACLE["prepared_backslash"] = "select * from (values ('a\\nb''s', 0.1::double), ('C:\\temp', (-2.5)::double)) t(v, d)"


def _replace_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed CREATE OR REPLACE TABLE leaves the old rows."""
    session = connect(spark)
    session.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    session.execute("create table r as select n_nationkey as k from nation")
    for text in ("create or replace table r as select cast(n_name as integer) as k from nation", "create table never as select cast(n_name as integer) as k from nation"):
        try:
            session.execute(text)
        except Exception:  # noqa: BLE001  whatever Spark raises for the cast
            continue
        raise AssertionError("a text was cast to a number")
    return session.sql("select k, (select count(*) from information_schema.tables) as tables from r")


QUERIES["replace_table_failed"] = _replace_failed
ORACLE["replace_table_failed"] = "select n_nationkey as k, 1 as tables from nation"


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of a folder, closed with held rows and opened again."""
    folder = f"{connect(spark).database.folder}/kept"
    with connect(spark, folder) as session:
        session.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
        session.execute(COPY + "create view rich as select id from c where balance > 5000; create unique index i on c (name); delete from c where nation = 1; create table h (a integer); insert into h values (7)")
    return connect(spark, folder).sql("select c.id, c.name, rich.id as top, h.a as held from c left join rich on c.id = rich.id cross join h")


QUERIES["reopen_database"] = _reopened
ORACLE["reopen_database"] = "select c_custkey as id, c_name as name, case when c_acctbal > 5000 then c_custkey end as top, 7 as held from customer where c_nationkey <> 1"


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by row id in a given order, with and without those that aren't there."""
    from tidewater.operators.frame import TableHandle

    session = connect(spark)
    session.execute("create table g (a integer, b text)")
    handle = TableHandle(session, "g")
    handle.insert_rows([{"a": 1, "b": "x"}, {"a": None, "b": None}, {"a": 3, "b": "z"}])
    ids = {r.a: r.rowid for r in session.sql("select a, rowid from g").collect()}
    asked = [ids[3], 10**9, ids[None], ids[1]]
    rows = [("include", *r) for r in handle.gather(asked).collect()] + [("drop", *r) for r in handle.gather(asked, nulls="drop").collect()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, policy string, a long, b string")


QUERIES["gather_rows"] = _gathered
ORACLE["gather_rows"] = "select * from (values (0, 'include', 3, 'z'), (1, 'include', null, null), (2, 'include', null, null), (3, 'include', 1, 'x'), (4, 'drop', 3, 'z'), (5, 'drop', 1, 'x')) t(place, policy, a, b)"


def outcomes(name: str, statements: list[tuple[str, bool]], setup: str = "") -> None:
    """Which statements are refused, by their place; the flags are what must come out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = connect(spark)
        session.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
        session.execute(setup)
        rows = []
        for place, (text, _) in enumerate(statements):
            try:
                session.execute(text)
                rows.append((place, False))
            except DialectError:
                rows.append((place, True))
        return spark.createDataFrame(rows, "place int, refused boolean")

    QUERIES[name] = run
    ORACLE[name] = "select * from (values " + ", ".join(f"({i}, {str(refused).lower()})" for i, (_, refused) in enumerate(statements)) + ") t(place, refused)"


PARENTS = "create table p (a integer primary key, b text unique, c integer not null default 4, d integer check (d < 10)); create table q (x integer references p(a), y integer, unique (x, y)); insert into p (a, b, d) values (1, 'x', 1), (2, null, null); insert into q values (1, 1)"
outcomes(
    "constraints_enforced",
    [
        ("insert into p (a) values (1)", True), ("insert into p (a, b) values (3, 'x')", True), ("insert into p values (3, 'y', null, 1)", True), ("insert into p (a, d) values (3, 10)", True),
        ("insert into p (a, b, d) values (3, null, 9)", False), ("insert into q values (9, 1)", True), ("insert into q values (null, 1)", False), ("insert into q values (1, 1)", True),
        ("update p set a = 1 where a = 2", True), ("update p set d = 11", True), ("delete from p where a = 1", True), ("delete from p where a = 2", False), ("drop table p", True), ("truncate table p", True),
    ],
    PARENTS,
)
outcomes("insert_or_abort", [("insert or abort into p (a) values (5), (1)", True), ("insert or fail into p (a) values (5), (1)", True), ("insert or rollback into p (a) values (5), (1)", True), ("insert or abort into p (a) values (5)", False), ("insert or fail into p (a) values (5)", True)], PARENTS)
outcomes(
    "unique_index",
    [("create unique index i on c (nation)", True), ("create unique index i on c (name)", False), ("create index i on c (id)", True), ("create index if not exists i on c (id)", False), ("insert into c select 100000001, name, 1, 1 from c where id = 1", True), ("reindex i", False), ("vacuum reindex i", False), ("reindex j", True), ("drop index i", False), ("drop index if exists i", False), ("insert into c select 100000001, name, 1, 1 from c where id = 1", False)],
    COPY,
)
outcomes("pragma_verification", [("pragma enable_verification", False), ("pragma disable_verification", False), ("pragma nothing", True), ("set immediate_transaction_mode = true", False), ("set constraint_enforcement_mode = 'deferred'", False), ("set constraint_enforcement_mode = sometimes", True), ("set nothing = 1", True)])
outcomes("union_strictness", [("select c_custkey from customer union select c_acctbal from customer", False), ("select c_custkey from customer union select c_name from customer", True), ("select c_custkey from v intersect select c_custkey from v", False), ("select c_custkey from v union select c_acctbal from w", True), ("select c_custkey from v except select c_custkey, c_name from customer", True)], "create view v as select c_custkey from customer; create view w as select c_acctbal from customer")
def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = connect(spark)
    session.execute("create type amount as integer; create table t (a amount, b text); insert into t values (1, 'x'), (2, 'y'), ; create index i on t (a); reindex i; create table t2 as values (1), (5)")
    return session.sql("select * exclude (b) from t indexed by i where a in (1, 2,) and b not in () and a in t2")


QUERIES["text_preprocessors"] = _preprocessed
ORACLE["text_preprocessors"] = "select 1 as a"


def _arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built table with rows, Arrow batches and a frame put into it."""
    session = connect(spark)
    session.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    handle = session.create_table("n").with_not_null_column("id", "bigint").with_column("name", "text").finish()
    arrow = session.sql("select n_nationkey as id, n_name as name from nation where n_nationkey < 20").toArrow()
    handle.insert_batches(arrow)
    handle.insert_lazy(session.scan("nation").filter("n_nationkey >= 20").select(id="n_nationkey", name="n_name"))
    handle.insert_rows([{"id": 100, "name": "None"}, {"id": 101, "name": None}])
    return handle.lazy().frame


QUERIES["arrow_batches"] = _arrow_batches
ORACLE["arrow_batches"] = "select n_nationkey as id, n_name as name from nation union all select * from (values (100, 'None'), (101, null)) t(id, name)"


def _join_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a streamed join: their rows, and that none is larger than asked for."""
    session = connect(spark)
    for t in ("nation", "region"):
        session.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    batches: list = []
    session.scan("nation").join_stream(session.scan("region"), [("n_regionkey", "r_regionkey")], batches.append, options=JoinOptions(batch_size=7))
    rows = [(n, r, max(b.num_rows for b in batches) <= 7) for b in batches for n, r in zip(b.column("n_name").to_pylist(), b.column("r_name").to_pylist(), strict=True)]
    return spark.createDataFrame(rows, "nation string, region string, small boolean")


QUERIES["join_stream"] = _join_stream
ORACLE["join_stream"] = "select n_name as nation, r_name as region, true as small from nation join region on n_regionkey = r_regionkey"


def _plan_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators of a plan as a graph's nodes."""
    session = connect(spark)
    session.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    graph = plan_graph(session.sql("select n_regionkey, count(*) as n from nation where n_nationkey > 3 group by n_regionkey order by n"))
    operators = {n for n, _ in graph.nodes}
    return spark.createDataFrame([(x, x in operators, len(graph.edges) == len(graph.nodes) - 1, f'label="{x}"' in graph.to_dot()) for x in ("Sort", "Aggregate", "Filter", "Window")], "operator string, there boolean, tree boolean, drawn boolean")


QUERIES["plan_graph"] = _plan_graph
ORACLE["plan_graph"] = "select * from (values ('Sort', true, true, true), ('Aggregate', true, true, true), ('Filter', true, true, true), ('Window', false, true, false)) t(operator, there, tree, drawn)"


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = connect(spark)
    path = f"{session.database.folder}/csv"
    csvio.export_csv(spark.read.parquet(f"{sf_dir}/customer.parquet"), path, {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "nullif(c_mktsegment, 'BUILDING')"}, where="c_acctbal > 0")
    csvio.ingest_csv(session, path, "c")
    return session.sql("select * from c")


QUERIES["csv_roundtrip"] = _csv_round_trip
ORACLE["csv_roundtrip"] = "select c_custkey as id, c_name as name, c_acctbal as balance, nullif(c_mktsegment, 'BUILDING') as segment from customer where c_acctbal > 0"


def _fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    frame = session.scan("customer").filter("c_acctbal > 0").aggregate(["c_nationkey"], n="count(*)", top="max(c_acctbal)")
    return frame.frame


QUERIES["fluent_frame"] = _fluent
ORACLE["fluent_frame"] = "select c_nationkey, count(*) as n, max(c_acctbal) as top from customer where c_acctbal > 0 group by c_nationkey"

QUERIES["events_tumbling"] = lambda spark, sf_dir: streams.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "cast(ts as timestamp) as t").drop("ts").withColumnRenamed("t", "ts")).selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "total")
ORACLE["events_tumbling"] = "select date_trunc('hour', ts) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,6))) as double) as total from events group by 1, 2"
