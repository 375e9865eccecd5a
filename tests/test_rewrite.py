"""Rewrites of the dialect, as text."""

import pytest

from tidewater.plans import rewrite as R
from tidewater.plans.tokens import DialectError, render, spark_spans, spark_sql, statements, tokenize
from tidewater.types import spark_type


def done(text: str, nulls_first: bool = False) -> str:
    return spark_sql(R.dialect(tokenize(text), nulls_first, {}))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("select * exclude (a, t.b) from x", "select * except (a, b) from x"),
        ("select 1 where a + 1 not in ()", "select 1 where (true)"),
        ("select 1 where a in ()", "select 1 where (false)"),
        ("select 1 where a in t", "select 1 where a in (select * from t)"),
        ("select sum(case when x is null then 1 else 0 end)", "select count_if((x) is null)"),
        ("select as struct a, b from t", "select struct(a, b) as value from t"),
        ("select distinct as value a + 1 from t", "select distinct a + 1 as value from t"),
        ("select a from t order by cast(a as integer)", "select a from t order by try_cast(a as bigint) nulls last"),
        (r"select 'a\nb', 'it''s'", r"select 'a\\nb', 'it''s'"),
        ("select d + interval '1 year 2 days', d - interval 3 months 4 days", "select d + interval '12' month + interval '2' day, d - interval '3' month - interval '4' day"),
        ("select d + interval '90' day, d + interval '1-3' year to month", "select d + interval '90' day, d + interval '1-3' year to month"),
        ("select * exclude (a) from t except select * from u", "select * except (a) from t except select * from u"),
        ("select a from t order by cast(a as varchar)", "select a from t order by cast(a as string) nulls last"),
        ("select random()", "select rand()"),
        ("select cast(a as varchar(10)), cast(b as int)", "select cast(a as string), cast(b as bigint)"),
        ("select cast(a as decimal)", "select cast(a as decimal(38, 0))"),
        ("select a from t order by a desc, b", "select a from t order by a desc nulls first, b nulls last"),
        ("select a from t indexed by i where a > 1", "select a from t where a > 1"),
        ('select "a""b" from t', 'select `a"b` from t'),
        ("select a -- note\n from t /* more */", "select a from t"),
    ],
)
def test_dialect(text, expected):
    assert done(text) == expected


def test_null_order_setting():
    assert done("select a from t order by a, b desc limit 3", True) == "select a from t order by a nulls first, b desc nulls last limit 3"


def test_struct_literal():
    assert "named_struct('a', 1, 'b', named_struct('c', 2))" in done("select {'a': 1, 'b': {'c': 2}}")


@pytest.mark.parametrize("text", ["select group_concat(distinct a, '-') from t", "select group_concat(a, b) from t", "select count(distinct *) from t"])
def test_refused(text):
    with pytest.raises(DialectError):
        done(text)


def test_types():
    assert spark_type(tokenize("smallint")) == "bigint"
    assert spark_type(tokenize("numeric(12, 3)")) == "decimal(12,3)"
    assert spark_type(tokenize("row(a int, b row(c text))")) == "struct<`a`:bigint,`b`:struct<`c`:string>>"
    for refused in ("blob", "timestamp", "json"):
        with pytest.raises(DialectError):
            spark_type(tokenize(refused))


def test_parameters():
    tokens, keys = R.parameters(tokenize("select ?, ?2, :name, $1"))
    assert keys == ["1", "2", "name"] and render(tokens) == "select :p_1, :p_2, :p_name, :p_1"


def kinds(*given):
    return lambda arguments, source: list(given)


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("select total(x) from t", "bigint", "select coalesce(sum(cast(x as double)), cast(0 as double)) from t"),
        ("select sum(x) from t", "bigint", "select sum(x) from t"),
        ("select sum(distinct x) from t", "decimal(10,2)", "select cast(sum(distinct x) as decimal(10, 2)) from t"),
        ("select total(x) from t", "decimal(10,2)", "select coalesce(cast(sum(x) as decimal(10, 2)), cast(0 as decimal(10, 2))) from t"),
    ],
)
def test_aggregates_by_type(text, kind, expected):
    assert spark_sql(R.aggregates(R.dialect(tokenize(text), False, {}), kinds(kind))) == expected


def test_scope_of_an_aggregate():
    seen = []

    def types(arguments, source):
        seen.append((sorted(render(a) for a in arguments), render(source)))
        return ["bigint"] * len(arguments)

    R.aggregates(tokenize("select sum(a) + (select avg(b) from u where c > 1) from t where d in (select 1 from v) group by e having sum(f) > 0 union select sum(1)"), types)
    assert sorted(seen) == [(["1"], ""), (["a", "f"], "from t"), (["b"], "from u")]


def test_statements_and_triggers():
    text = "create trigger a insert on t begin select case when 1 then 2 end; delete from t; end; select 1; begin; end"
    assert [render(s).split()[0] for s in statements(tokenize(text))] == ["create", "select", "begin", "end"]


def test_spans():
    text, begins = spark_spans(tokenize("select '\U0001f600' as a, b"))
    units = text.encode("utf-16-le")
    assert [units[2 * a : 2 * a + 2].decode("utf-16-le") for a in begins] == ["s", "'", "a", "a", ",", "b"]
