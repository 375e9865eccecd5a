"""Statements, constraints and transactions, and the semantics that differ from Spark's."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewater import slt
from tidewater.functions import semantics as S
from tidewater.plans.graph import plan_graph
from tidewater.plans.tokens import DialectError
from tidewater.session import Session, connect
from tidewater.sources import csvio


@pytest.fixture
def db(spark):
    return connect(spark)


def rows(session, text, *args):
    return sorted((tuple(r) for r in session.sql(text, *args).collect()), key=repr)


def test_distinct_aggregates(db):
    db.execute("create table numbers (val bigint); insert into numbers values (1), (1), (2)")
    assert rows(db, "select sum(distinct val), sum(distinct 52), total(distinct val), count(distinct val) from numbers") == [(3, 52, 3.0, 2)]


def test_integer_division(db):
    db.execute("create table t (a integer, b integer, x double); insert into t values (7, 2, 7), (-7, 2, 1), (5, 0, 0), (null, 1, null)")
    assert rows(db, "select a / b from t where a is not null order by 1") == sorted([(3,), (-3,), (None,)], key=repr)
    assert rows(db, "select 100 / 7 / 2, 100 / (7 / 2), 2 + 9 / 2 * 2") == [(7, 33, 10)]
    assert rows(db, "select x / 2, sum(a) / count(b) from t where x = 7 group by x") == [(3.5, 7)]
    assert rows(db, "select a from t where a / b > 2") == [(7,)]
    assert rows(db, "select (select max(a) from t) / 2") == [(3,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        rows(db, "select a % b from t")


def test_correlated_subqueries(db):
    db.execute("create table outer_table (id bigint, value bigint); create table inner_table (outer_id bigint, amount bigint)")
    db.execute("insert into outer_table values (1, 10), (2, 20); insert into inner_table values (1, 5), (1, 3), (2, 8)")
    assert rows(db, "select id, (select min(amount) from inner_table where outer_id = id) from outer_table") == [(1, 3), (2, 8)]
    db.execute("create table part (p bigint, name text); create table supplier (s bigint); create table partsupp (ps_p bigint, ps_s bigint, cost bigint)")
    db.execute("insert into part values (1, 'a'), (2, 'b'); insert into supplier values (1), (2); insert into partsupp values (1, 1, 10), (1, 2, 5), (2, 1, 7), (2, 2, 9)")
    assert rows(db, "select p, s from part, supplier, partsupp where p = ps_p and s = ps_s and cost = (select min(cost) from partsupp where p = ps_p)") == [(1, 2), (2, 1)]


def test_constraints(db):
    db.execute("create table p (a integer primary key, b text unique, c integer not null default 4, check (a < 100))")
    assert db.execute("insert into p (a, b) values (1, 'x'), (2, null), (3, null)").rows == 3
    for bad in ("insert into p (a, b) values (1, 'y')", "insert into p (a, b) values (4, 'x')", "insert into p values (5, 'z', null)", "insert into p (a) values (100)", "insert into p (a) values (null)", "update p set a = 1 where a = 2", "insert into p (a, b) values (7, 'q'), (7, 'r')"):
        with pytest.raises(DialectError, match="Constraint"):
            db.execute(bad)
    assert rows(db, "select * from p") == [(1, "x", 4), (2, None, 4), (3, None, 4)]
    db.execute("insert or ignore into p (a, b) values (1, 'n'), (9, 'n'), (9, 'm'); insert or replace into p (a, b, c) values (2, 'new', 0)")
    assert rows(db, "select * from p") == sorted([(1, "x", 4), (2, "new", 0), (3, None, 4), (9, "n", 4)], key=repr)


def test_foreign_keys(db):
    db.execute("create table p (a integer primary key); create table c (x integer references p(a), y integer); insert into p values (1), (2); insert into c values (1, 1), (null, 2)")
    for bad in ("insert into c values (3, 3)", "delete from p where a = 1", "update p set a = 5 where a = 1", "update c set x = 9", "drop table p", "truncate table p"):
        with pytest.raises(DialectError):
            db.execute(bad)
    db.execute("delete from p where a = 2; update c set x = null; delete from p; drop table c; drop table p")
    db.execute("create table tree (id integer primary key, up integer references tree(id)); insert into tree values (1, null), (2, 1), (3, 2)")
    with pytest.raises(DialectError):
        db.execute("delete from tree where id = 2")
    with pytest.raises(DialectError):
        db.execute("create table bad (x integer references tree(up))")


def test_transactions(spark, db):
    other = Session(spark, db.database)
    db.execute("create table t (a integer); insert into t values (1)")
    db.flush()
    db.execute("begin; insert into t values (2)")
    assert rows(db, "select * from t") == [(1,), (2,)] and rows(other, "select * from t") == [(1,)]
    db.execute("commit")
    assert rows(other, "select * from t") == [(1,), (2,)]
    db.execute("begin; delete from t; rollback")
    assert len(rows(db, "select * from t")) == 2
    db.execute("begin; update t set a = a + 10")
    other.execute("begin; update t set a = a + 20; commit")
    with pytest.raises(DialectError, match="conflict"):
        db.execute("commit")
    assert rows(db, "select * from t") == [(21,), (22,)]
    db.execute("begin")
    with pytest.raises(DialectError):
        db.execute("insert into missing values (1)")
    with pytest.raises(DialectError, match="transaction is aborted"):
        db.execute("select 1")
    assert db.execute("commit").kind == "rollback"


def test_snapshot_of_a_query(db):
    db.execute("create table t (a integer); insert into t values (1)")
    before = db.sql("select * from t")
    db.execute("update t set a = 2")
    assert before.collect()[0].a == 1 and rows(db, "select * from t") == [(2,)]


def test_names(db):
    db.execute('create schema s; create table s.t (t row(t bigint)); insert into s.t values ({\'t\': 42}); create table "Mixed" ("COL1" integer)')
    assert rows(db, "select t.t.t from s.t") == [(42,)] and rows(db, "select s.t.t.t from s.t") == [(42,)]
    assert db.sql("select * from mixed").columns == ["COL1"]
    with pytest.raises(DialectError):
        db.execute("drop schema s")
    db.execute("drop schema s cascade")


def test_metadata(db):
    db.execute("create table t (a integer primary key, b text default 'x'); create unique index i on t (b); create view v as select a from t")
    assert rows(db, "select name, pk from pragma_table_info('t')") == [("a", True), ("b", False)]
    assert rows(db, "select table_name, table_type from information_schema.tables") == [("t", "BASE TABLE"), ("v", "VIEW")]
    assert rows(db, "select column_name from information_schema.key_column_usage") == [("a",)]
    db.execute("insert into t values (1, 'x')")
    with pytest.raises(DialectError):
        db.execute("insert into t values (2, 'x')")
    db.execute("reindex i; vacuum reindex i; drop index i; pragma enable_verification")
    with pytest.raises(DialectError):
        db.execute("vacuum")


def test_prepared(db):
    db.execute("create table t (a integer, b text); insert into t values (1, 'x'), (2, 'y')")
    assert [tuple(r) for r in db.prepare("select b from t where a = ?").sql(2).collect()] == [("y",)]
    db.prepare("insert into t values (?, ?)").execute(3, "it's")
    db.prepare("update t set b = :name where a = :key").execute(name="z", key=1)
    assert rows(db, "select * from t") == [(1, "z"), (2, "y"), (3, "it's")]
    with pytest.raises(DialectError):
        db.prepare("select ?").sql()


def test_decimal_average(spark):
    frame = spark.sql("select cast(x as decimal(10,2)) x from values (1.00), (1.01), (-5.00), (null) as v(x)")
    assert frame.where("x > 0").agg(S.avg_decimal("x", 10, 2)).first()[0] == Decimal("1.01")
    assert frame.agg(S.avg_decimal("x", 10, 2)).first()[0] == Decimal("-1.00")
    assert frame.where("x > 99").agg(S.avg_decimal("x", 10, 2), S.total("x")).first() == (None, 0.0)


def test_meanings_as_columns(spark):
    """The helpers for DataFrame code give what the dialect gives."""
    frame = spark.sql("select * from values (7, 2, 7.0D, date '2024-01-31'), (-7, 2, 1.0D, date '2023-12-31'), (5, 0, 0.0D, null) as v(a, b, x, d)")
    assert [r[0] for r in frame.select(S.int_div("a", "b")).collect()] == [3, -3, None]
    assert [r[0] for r in frame.select(S.divide("x", F.col("b").cast("double"))).collect()] == [3.5, 0.5, None]
    assert frame.where("b > 0").select(S.modulo("a", "b"), S.as_int(S.as_bool("x"))).collect() == [(1, 1), (-1, 1)]
    assert frame.agg(S.total("a"), S.total_distinct("b"), S.count_nulls("d"), S.sum_decimal(F.col("a").cast("decimal(10,2)"), 10, 2)).first() == (5.0, 2.0, 1, Decimal("5.00"))
    assert [str(r[0]) for r in frame.where("d is not null").select(S.add_interval("d", 1, 1)).collect()] == ["2024-03-01", "2024-02-01"]
    assert frame.select(S.date_diff("d", F.lit("2024-01-01").cast("date"))).first()[0] == 30
    assert frame.where(S.in_empty()).count() == 0 and frame.where(S.in_empty(True)).count() == 3
    assert [r.d is None for r in frame.orderBy(S.order("d")).collect()] == [False, False, True]
    assert [r.d is None for r in frame.orderBy(S.order("d", True)).collect()] == [True, False, False]


def test_text_sum_and_group_concat(spark, db):
    frame = spark.sql("select * from values (' 1.5 '), ('x'), (null) as v(x)")
    assert frame.agg(S.sum_text("x"), S.group_concat("x", "|")).first() == (1.5, " 1.5 |x")
    db.execute("create table e (a text)")
    assert rows(db, "select group_concat(a), total(a) from e") == [(None, 0.0)]


def test_joins(db):
    db.execute("create table l (k integer, v text); create table r (k integer, w text); insert into l values (1, 'a'), (2, 'b'), (null, 'n'), (2, 'c'); insert into r values (2, 'x'), (2, 'y'), (null, 'm'), (3, 'z')")
    left, right = db.scan("l"), db.scan("r")
    assert left.join(right, [("k", "k")]).frame.count() == 4
    assert left.join(right, [("k", "k")], null_safe=True).frame.count() == 5
    assert left.join(right, [("k", "k")], "left").frame.count() == 6
    assert left.join(right, [("k", "k")], "semi").frame.count() == 2 and left.join(right, [("k", "k")], "anti").frame.count() == 2
    assert left.join(right, []).frame.count() == 16


def test_fluent(spark, db):
    import pyarrow as pa

    table = db.create_table("u").with_not_null_column("id", "bigint").with_column("name", "text").finish()
    table.insert_rows([{"id": 1, "name": "alice"}, {"id": 2, "name": "bob"}])
    table.insert_batches(pa.table({"id": [38], "name": [None]}))
    assert table.lazy().aggregate(s="sum(id)").collect_rows()[0].s == 41
    assert table.lazy().filter("id / 2 = 1").select(n="name").collect().to_pylist() == [{"n": "bob"}]
    with pytest.raises(DialectError):
        table.insert_rows([{"id": None, "name": "x"}])


def test_csv(spark, db, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text('id,name,score,code\n1,"a,b",1.5,007x\n 2 ,NA,2,8\n3,"q""q",NA,9\n')
    assert csvio.infer_schema(spark, str(file), null_token="NA") == {"id": "bigint", "name": "string", "score": "double", "code": "string"}
    assert csvio.ingest_csv(db, str(file), "t", {"code": "label"}, null_token="NA") == 3
    assert rows(db, "select id, name, score, label from t") == sorted([(1, "a,b", 1.5, "007x"), (2, None, 2.0, "8"), (3, 'q"q', None, "9")], key=repr)
    csvio.export_csv(db.sql("select * from t"), str(tmp_path / "out"), {"double_id": "id * 2"}, where="id > 1")
    assert sorted(r[0] for r in csvio.read_csv(spark, str(tmp_path / "out")).collect()) == [4, 6]


def test_csv_types_come_from_all_rows(spark, db, tmp_path):
    file = tmp_path / "long.csv"
    file.write_text("n,late,money\n" + "".join(f'{i},{i},"$1,000"\n' for i in range(1500)) + '1500,1.5,(20)\n1501,2.5,5%\n1502,,7\n')
    assert csvio.infer_schema(spark, str(file)) == {"n": "bigint", "late": "double", "money": "bigint"}
    assert csvio.ingest_csv(db, str(file), "long") == 1503
    got = db.sql("select count(late), sum(late), sum(money) from long").collect()[0]
    assert tuple(got) == (1502, sum(range(1500)) + 4.0, 1500 * 1000 - 20 + 5 + 7)


def test_booleans_and_numbers(db):
    """Comparisons are numbers and numbers are conditions, wherever they stand."""
    db.execute("create table t (id integer, f boolean, x double); insert into t values (1, true, 0.5), (2, false, 0), (0, null, 2)")
    assert rows(db, "select id from t where f = 1") == [(1,)] and rows(db, "select id from t where 0 = f") == [(2,)]
    assert rows(db, "select (id > 1) + 1, 2 * (id = 0) - f from t where id > 0") == [(1, -1), (2, 0)]
    assert rows(db, "select id and 1, id or f, not id from t where id <> 1") == sorted([(True, True, False), (False, None, True)], key=repr)
    assert rows(db, "select case when id then 'y' else 'n' end, case f when 1 then 'a' end from t") == sorted([("y", "a"), ("y", None), ("n", None)], key=repr)
    assert rows(db, "select coalesce(f, 7), nullif(f, 0), abs(f) from t") == sorted([(1, 1, 1), (0, None, 0), (7, None, None)], key=repr)
    assert rows(db, "select id from t where f in (1, 3)") == [(1,)] and rows(db, "select id from t where f not in (1, 3)") == [(2,)]
    assert rows(db, "select id from t where f between 1 and 2") == [(1,)] and rows(db, "select id from t where not f between 1 and 2") == [(2,)]
    assert rows(db, "select sum(id > 0), sum((id > 1) / 1) from t") == [(2, 1)]
    assert rows(db, "select id from t where x and id") == [(1,)] and rows(db, "select -(id > 0) from t where id = 1") == [(-1,)]
    assert rows(db, "select case when id > 0 then f else 5 end from t") == [(0,), (1,), (5,)]
    db.execute("update t set x = (id > 1) + 1 where f = 1; delete from t where f = 0")
    assert rows(db, "select id, x from t") == [(0, 2.0), (1, 1.0)]
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        rows(db, "select sum(f) from t")


def test_types_of_sums(db):
    db.execute("create table d (g integer, v decimal(10,2), s text); insert into d values (1, 1.00, ' 1.5 '), (1, 1.01, 'x'), (2, -5.00, null), (2, null, '2')")
    assert rows(db, "select avg(v), sum(v), total(v), avg(distinct v) from d where v > 0") == [(Decimal("1.01"), Decimal("2.01"), Decimal("2.01"), Decimal("1.01"))]
    assert rows(db, "select sum(s), avg(s), total(s), sum(distinct s) from d") == [(3.5, 3.5 / 3, 3.5, 3.5)]
    assert rows(db, "select g, total(v), sum(s) from d group by g having sum(s) > 1") == [(1, Decimal("2.01"), 1.5), (2, Decimal("-5.00"), 2.0)]
    assert rows(db, "select total(v), sum(v), sum(case when v is null then 1 else 0 end) from d where g > 9") == [(Decimal("0.00"), None, 0)]
    assert rows(db, "select g, (select sum(s) from d i where i.g = o.g) from d o where v > 1") == [(1, 1.5)]
    assert [r[0] for r in db.sql("select s from d order by cast(s as integer), s").collect()] == ["2", " 1.5 ", "x", None]


def test_set_operations_are_strict(db):
    db.execute("create table t (a integer, b text, c double); insert into t values (1, 'x', 1.5); create view v as select a from t; create view w as select c from t")
    assert rows(db, "select a from t union select c from t union all select null from t") == sorted([(1.0,), (1.5,), (None,)], key=repr)
    for bad in ("select a from t union select b from t", "select b from t except select c from t", "select a from v union select c from w", "select a from t union select a, b from t"):
        with pytest.raises(DialectError, match="Binder Error"):
            rows(db, bad)


def test_replacing_is_atomic(db):
    db.execute("create table r (k integer primary key, v text); insert into r values (1, 'x'); create unique index i on r (v)")
    for bad in ("create or replace table r as select cast('x' as integer) as k", "create table n as select cast('x' as integer) as k", "create or replace table r (k integer, k text)", "create or replace table r as select 1 as k, 2 as K"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|duplicate"):
            db.execute(bad)
    assert rows(db, "select * from r") == [(1, "x")] and rows(db, "select table_name from information_schema.tables") == [("r",)]
    with pytest.raises(DialectError):
        db.execute("insert into r values (2, 'x')")
    db.execute("create or replace table r as select v, v as w from r union all select 'x', 'y'; insert into r values ('x', 'y')")
    assert rows(db, "select * from r") == [("x", "x"), ("x", "y"), ("x", "y")]
    db.execute("create table child (a integer primary key); create table c2 (a integer references child(a))")
    with pytest.raises(DialectError, match="main key table"):
        db.execute("create or replace table child as select 1 as a")


STRINGS = ["a\\nb", "C:\\temp", "\\", "it's", "x\\'y", "tab\\t \\u0041", '"q"', "`"]


def test_strings_stay_as_they_are(db):
    table = db.create_table("s").with_column("v", "text").finish()
    for v in STRINGS:
        db.execute("insert into s values ('" + v.replace("'", "''") + "')")
        db.prepare("insert into s values (?)").execute(v)
    table.insert_rows([{"v": v} for v in STRINGS])
    assert [r[0] for r in rows(db, "select v from s")] == sorted([v for v in STRINGS for _ in range(3)], key=lambda v: repr((v,)))
    for v in STRINGS:
        assert db.prepare("select count(*) as n from s where v = ?").sql(v).first().n == 3
        assert rows(db, "select '" + v.replace("'", "''") + "', length('" + v.replace("'", "''") + "')") == [(v, len(v))]
    assert db.prepare("update s set v = :to where v = :from").execute(**{"to": "\\\\", "from": "\\"}).rows == 3
    assert db.prepare("delete from s where v = ?").execute("\\\\").rows == 3


def test_inserted_values(db):
    table = db.create_table("k").with_column("x", "double").with_column("d", "decimal(10,2)").with_column("n", "integer").with_column("t", "date").finish()
    table.insert_rows([{"x": float("nan"), "d": 1.005, "n": True, "t": "2024-02-29"}, {"x": float("-inf"), "d": Decimal("2"), "n": 3, "t": None}, {"x": 1, "d": None, "n": None, "t": None}])
    db.prepare("insert into k (x, n) values (?, ?)").execute(float("nan"), 4)
    assert repr(rows(db, "select x, d, n, cast(t as text) from k where n is not null")) == repr(sorted([(float("nan"), Decimal("1.01"), 1, "2024-02-29"), (float("-inf"), Decimal("2.00"), 3, None), (float("nan"), None, 4, None)], key=repr))


def test_held_rows_are_seen_by_others(spark, db):
    other = Session(spark, db.database)
    db.execute("create table h (a integer)")
    for i in range(3):
        db.execute(f"insert into h values ({i})")
    assert db.held is not None and rows(other, "select count(*) from h") == [(3,)]
    db.execute("insert into h values (3)")
    own = db.database
    del db
    assert other.scan("h").frame.count() == 4
    with Session(spark, own) as third:
        third.execute("insert into h values (4); begin; insert into h values (5)")
    assert rows(other, "select count(*) from h") == [(5,)]


def test_deferred_keys(db):
    db.execute("create table p (a integer primary key); create table c (x integer references p(a)); set constraint_enforcement_mode = deferred")
    with pytest.raises(DialectError, match="does not exist in the referenced table"):
        db.execute("insert into c values (1)")
    db.execute("begin; insert into c values (1); insert into p values (1), (2), (2); delete from p where a = 2; commit")
    assert rows(db, "select x from c") == [(1,)]
    for bad in ("insert into p values (1)", "delete from p", "insert into c values (9)"):
        db.execute(f"begin; {bad}")
        with pytest.raises(DialectError, match="Constraint Error"):
            db.execute("commit")
    assert rows(db, "select a from p") == [(1,)] and rows(db, "select x from c") == [(1,)]
    with pytest.raises(DialectError):
        db.execute("set constraint_enforcement_mode = later")


def test_triggers_are_described(db):
    db.execute("create table t (a integer, b integer)")
    db.execute("begin; insert into t values (1, 1); create trigger x after update of a, b on t for each row when (new.a > 1) begin insert into t values (1, 2); select case when 1 then 2 end; end; rollback")
    assert rows(db, "select count(*) from t") == [(0,)] and db.state.triggers == {}
    db.execute("create trigger y delete on t begin insert into t values (7, 7); end; delete from t; insert into t values (1, 2)")
    trigger = db.state.triggers["y"]
    assert (trigger.timing, trigger.event, trigger.table) == ("BEFORE", "DELETE", "t") and rows(db, "select a from t") == [(1,)]
    for bad in ("create trigger y insert on t begin delete from t; end", "create trigger z insert on nowhere begin delete from t; end", "create trigger z insert on t begin delete from t;"):
        with pytest.raises(DialectError):
            db.execute(bad)
    db.execute("drop trigger y; create trigger y insert on t begin delete from t; end; drop table t")
    assert db.state.triggers == {}


def test_reopening(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    with connect(spark, folder) as db:
        db.execute("create schema s; create type money as decimal(10,2); create table s.t (id integer primary key, v money default 1.5, w text not null, check (id < 100)); create table u (id integer references s.t(id))")
        db.execute("insert into s.t (id, w) values (1, 'a'), (2, 'b'); create view big as select id from s.t where id > 1; create temp table gone (a integer); create trigger g insert on u begin delete from u; end")
        db.execute("alter table s.t rename column w to label; insert into u values (1); create table h (a integer); insert into h values (1)")
    again = connect(spark, folder)
    assert rows(again, "select * from s.t") == [(1, Decimal("1.50"), "a"), (2, Decimal("1.50"), "b")] and rows(again, "select * from big") == [(2,)] and rows(again, "select * from h") == [(1,)]
    assert "gone" not in again.state.tables and again.state.triggers["g"].table == "u" and again.state.types == {"money": "decimal(10,2)"}
    for bad in ("insert into s.t (id, label) values (1, 'x')", "insert into u values (7)", "insert into s.t (id, label) values (100, 'x')", "insert into s.t (id) values (5)"):
        with pytest.raises(DialectError, match="Constraint Error"):
            again.execute(bad)
    # two processes: one that has read an older version sees the newer and can't overwrite it
    first, second = connect(spark, folder), connect(spark, folder)
    first.execute("begin; update h set a = a + 1")
    second.execute("update h set a = a + 10")
    with pytest.raises(DialectError, match="conflict"):
        first.execute("commit")
    assert rows(first, "select a from h") == [(11,)]
    for i in range(15):
        first.execute(f"delete from h; insert into h values ({i})")
    first.flush()
    assert rows(second, "select a from h") == [(14,)] and len(first.database.journal.versions()) <= 11
    assert first.database.compact("h") == 1 and first.database.remove_unreferenced() > 10 and rows(connect(spark, folder), "select a from h") == [(14,)]


def test_only_touched_segments_are_rewritten(db):
    db.execute("create table t (a integer primary key, b integer)")
    for i in range(4):
        db.execute(f"insert into t select id, {i} from range({i * 10}, {i * 10 + 10})")
    before = db.state.tables["t"].segments
    assert db.execute("update t set b = 9 where a = 15").rows == 1
    now = db.state.tables["t"].segments
    assert set(before) - set(now) == {before[1]} and len(now) == 4
    assert db.execute("delete from t where a < 10").rows == 10 and len(db.state.tables["t"].segments) == 3
    assert db.execute("insert or replace into t values (25, 0), (99, 1)").rows == 2 and before[3] in db.state.tables["t"].segments and before[2] not in db.state.tables["t"].segments
    assert db.execute("update t set b = 1 where a > 1000").rows == 0
    with pytest.raises(DialectError, match="Duplicate key"):
        db.execute("update t set a = 30 where a = 15")
    assert rows(db, "select count(*), sum(a), sum(b) from t") == [(31, sum(range(10, 40)) + 99, 9 * 1 + 9 + 9 * 2 + 30 + 1)]
    segments = db.state.tables["t"].segments
    db.execute("alter table t rename column b to c; alter table t rename to u")
    assert db.state.tables["u"].segments == segments and rows(db, "select a, c from u where a = 15") == [(15, 9)]
    db.execute("insert into u (a, c) values (200, 5); alter table u drop column c")
    assert rows(db, "select * from u where a >= 99") == [(200,), (99,)]
    assert db.database.compact("u") > 1 and rows(db, "select count(*) from u") == [(32,)] and len(db.state.tables["u"].segments) == 1


def test_renamed_tables_keep_what_belongs_to_them(db):
    db.execute("create table t (a integer, b text); create unique index i on t (a); create trigger g insert on t begin delete from t; end; insert into t values (1, 'x'); alter table t rename to u")
    assert db.state.indexes["i"][0] == "u" and db.state.triggers["g"].table == "u"
    with pytest.raises(DialectError, match="Duplicate key"):
        db.execute("insert into u values (1, 'y')")
    for bad in ("alter table u rename column a to c", "alter table u rename column b to a", "alter table t drop column b", "alter table u add column z integer"):
        with pytest.raises(DialectError):
            db.execute(bad)
    db.execute("drop index i; alter table u rename column a to c; alter table u rename column b to a; alter table u alter column c set data type text; insert into u values ('2', 'y')")
    assert rows(db, "select c, a from u") == [("1", "x"), ("2", "y")]


def test_sessions_bind_their_own_snapshot(spark, db):
    other = Session(spark, db.database)
    db.execute("create table t (a integer); insert into t values (1)")
    db.execute("begin; update t set a = 2")
    mine, theirs = db.sql("select a from t"), other.sql("select a from t")
    assert mine.first().a == 2 and theirs.first().a == 1
    db.execute("rollback; create view v as select a from t; drop table t")
    with pytest.raises(DialectError, match="Catalog Error: Table with name t does not exist"):
        db.sql("select * from v")


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("select test.t.col from test.tbl t", "Binder Error.*table.*not found"),
        ("select testX.tbl.col from test.tbl", "Binder Error.*table.*not found"),
        ("select test.tblX.col from test.tbl", "Binder Error.*table.*not found"),
        ("select test.tbl.colX from test.tbl", "Binder Error.*does not have a column"),
        ("select nothing from test.tbl", "Binder Error.*does not have a column"),
        ("drop table p", "Could not drop the table because this table is main key table"),
        ("alter table p rename to q", "Dependency Error"),
        ("alter table c rename column x to z", "is involved in the foreign key constraint"),
        ("alter table p drop column a", "there is a UNIQUE constraint that depends on it"),
        ("alter table c drop column x", "there is a FOREIGN KEY constraint that depends on it"),
        ("alter table p alter column a set data type text", "Cannot change the type of a column that has a UNIQUE or PRIMARY KEY"),
        ("create table d (x integer references v(a))", "cannot reference a VIEW"),
        ("create table d (x integer references p(nope))", "does not have a column named"),
        ("insert into p values (1)", "Duplicate key.*violates primary key constraint.*constraint violation"),
        ("delete from p where a = 1", "Violates foreign key constraint.*still referenced by a foreign key in a different table"),
        ("commit", "TransactionContext Error"),
    ],
)
def test_messages(db, text, message):
    db.execute("create schema test; create table test.tbl (col integer); create table p (a integer primary key); create table c (x integer references p(a)); insert into p values (1); insert into c values (1); create view v as select a from p")
    with pytest.raises(DialectError, match=message):
        db.execute(text)


def test_join_options(db):
    from tidewater.operators.frame import JoinOptions

    db.execute("create table l (k integer, v text); create table r (k integer, w text); insert into l values (1, 'a'), (2, 'b'), (2, 'c'); insert into r values (2, 'x'), (2, 'y')")
    left, right = db.scan("l"), db.scan("r")
    for options, operator in ((JoinOptions("hash"), "ShuffledHashJoin"), (JoinOptions("merge"), "SortMergeJoin"), (JoinOptions("hash", memory_limit_bytes=1), "SortMergeJoin")):
        joined = left.join(right, [("k", "k")], options=options).frame
        assert operator in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 4
    batches = []
    left.join_stream(right.select(j="k", w="w"), [("k", "j")], batches.append, options=JoinOptions(batch_size=3))
    assert [b.num_rows for b in batches] == [3, 1] and sorted(x for b in batches for x in b.column(1).to_pylist()) == ["b", "b", "c", "c"]
    with pytest.raises(DialectError):
        left.join(right, [("k", "k")], options=JoinOptions("loop"))


def test_gather(db):
    table = db.create_table("g").with_column("a", "integer").with_column("b", "text").finish()
    table.insert_rows([{"a": 1, "b": "x"}, {"a": None, "b": None}])
    ids = {r.a: r.rowid for r in db.sql("select a, rowid from g").collect()}
    assert [r.a for r in table.gather([ids[None], ids[1], ids[1], 10**6], ["a"]).collect()] == [None, 1, 1, None]
    assert [tuple(r) for r in table.gather([10**6, ids[None], ids[1]], nulls="drop").collect()] == [(1, "x")]
    with pytest.raises(DialectError):
        table.gather([10**6], nulls="error")
    assert table.gather([]).collect() == []


def test_command_line(spark, monkeypatch, capsys, tmp_path):
    import io

    from tidewater.__main__ import main

    monkeypatch.setattr("sys.stdin", io.StringIO("create table t (a text); insert into t values ('x\\n;y'); select a, length(a) as n from t;"))
    assert main([]) == 0
    out = capsys.readouterr().out
    assert "insert: 1 rows" in out and "|x\\n;y|5" in out
    (tmp_path / "a.slt").write_text("query I\nSELECT 1 + 1\n----\n2\n")
    assert main(["--slt", str(tmp_path / "a.slt")]) == 0 and "1 records passed" in capsys.readouterr().out


def test_plan_graph(spark):
    graph = plan_graph(spark.range(5).where("id > 1").groupBy("id").count())
    assert graph.edges and "digraph" in graph.to_dot() and '"operator"' in graph.to_json()


SCRIPT = """
statement ok
CREATE TABLE t1(a INTEGER, b INTEGER)

loop i 0 3

statement ok
INSERT INTO t1 VALUES(${i}, NULL)

endloop

query II nosort
SELECT a, coalesce(b, a + 1) FROM t1 ORDER BY 1 DESC
----
2
3
1
2
0
1

query I rowsort
SELECT a = 1 FROM t1
----
0
0
1

skipif tidewater
statement ok
THIS IS SKIPPED

statement error
SELECT nothing FROM t1
----
<REGEX>:.*nothing.*

statement ok con1
BEGIN

statement ok con1
DELETE FROM t1

query I
SELECT count(*) FROM t1
----
3
"""


def test_logic_script(db):
    assert slt.run(db, SCRIPT) == 10
    with pytest.raises(slt.Failed):
        slt.run(db, "query I\nSELECT 1\n----\n2\n")
