"""One query for each operator, over the driver's tables, and its DuckDB twin.

The Spark side is DataFrame code or SQL as a user would write it; sums are taken over exact decimals
so that no result depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import semantics as S
from tidewater.operators.frame import JoinOptions

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events".split()

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Attribute access to a directory's tables; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None):
    """Register a DataFrame query over ``Tables``."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in the engine's dialect; ``oracle`` is the same text unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.session import Session

        session = Session(spark)
        for t in TABLES:
            if t in text:
                session.register(t, read(spark, sf_dir, t))
        return session.sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or text


def frames(name: str, oracle: str, build: Callable) -> None:
    """Register a query of the fluent API; ``build`` gets a function from table names to frames."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.operators.frame import Frame
        from tidewater.session import Session

        session = Session(spark)
        return build(lambda table: Frame(session, read(spark, sf_dir, table))).frame

    QUERIES[name], ORACLE[name] = run, oracle


M = "cast({} as decimal(15,2))"
PRICE, DISC, TAX, QTY = (M.format(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))


def money(c: str):
    return F.col(c).cast("decimal(15,2)")


# -- scans and projections ----------------------------------------------------------------------

sql("scan_parquet", "select * from region")
sql("select_columns", "select c_custkey, c_name from customer")
sql("select_alias", "select c_custkey as id, c_name as label from customer")
query("select_computed", "select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2))) as double) as net from lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("net"))
)
sql("select_star_except", "select * exclude (c_acctbal, c_mktsegment) from customer")
sql("select_distinct", "select distinct l_returnflag, l_linestatus from lineitem")
sql("select_constant", "select 42 as answer, 'x' as letter")
sql("values_inline", "select * from (values (1, 'a'), (2, 'b'), (3, null)) as v(id, letter)")
sql("range_source", "select id, id * id as square from range(100)", "select range as id, range * range as square from range(100)")
sql(
    "struct_field_access",
    "select c_custkey, s.name, s.place.nation from (select c_custkey, named_struct('name', c_name, 'place', named_struct('nation', c_nationkey)) as s from customer) d where s.place.nation > 10",
    "select c_custkey, c_name as name, c_nationkey as nation from customer where c_nationkey > 10",
)
sql("struct_literal", "select {'a': 1, 'b': 'x'}.a as a, {'a': 1, 'b': 'x'}.b as b")
sql("derived_table", "select n_regionkey, k from (select n_regionkey, n_nationkey * 2 as k from nation) d where k > 10")
sql("select_as_struct", "select d.value.n_nationkey as n_nationkey, d.value.name as name from (select as struct n_nationkey, n_name as name from nation) d", "select n_nationkey, n_name as name from nation")
sql("select_as_value", "select value from (select as value n_regionkey + 1 from nation) d", "select n_regionkey + 1 as value from nation")
sql("scan_ordered_page", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 20 offset 40")
sql("scan_key_range", "select o_orderkey from orders where o_orderkey >= 100 and o_orderkey < 500")
sql("gather_by_key", "select o_orderkey, o_orderstatus from orders where o_orderkey in (1, 5, 9, 33, 100)")

# -- predicates ---------------------------------------------------------------------------------

for _name, _where in {
    "filter_eq": "c_nationkey = 7",
    "filter_ne": "c_nationkey <> 7",
    "filter_range": "c_acctbal > 100 and c_acctbal <= 5000",
    "filter_between": "c_custkey between 10 and 60",
    "filter_not_between": "c_custkey not between 10 and 60",
    "filter_not_not": "not not c_custkey between 10 and 60",
    "filter_in_list": "c_mktsegment in ('BUILDING', 'MACHINERY')",
    "filter_not_in_null": "c_nationkey not in (1, 2, null)",
    "filter_not_in_list": "c_nationkey not in (1, 2, 3)",
    "filter_like_prefix": "c_name like 'Customer#0000001%'",
    "filter_like_suffix": "c_name like '%7'",
    "filter_like_contains": "c_mktsegment like '%IL%'",
    "filter_like_exact": "c_mktsegment like 'BUILDING'",
    "filter_like_insensitive": "lower(c_mktsegment) like '%il%'",
    "filter_is_null": "nullif(c_nationkey, 3) is null",
    "filter_is_not_null": "nullif(c_nationkey, 3) is not null",
    "filter_and_or_not": "(c_nationkey < 5 or c_nationkey > 20) and not (c_mktsegment = 'BUILDING' and c_acctbal < 0)",
    "filter_true_literal": "true and c_custkey < 20",
    "filter_column_compare": "c_custkey > c_nationkey * 10",
    "filter_null_compare": "nullif(c_nationkey, 3) > 2",
    "filter_in_subquery": "c_nationkey in (select n_nationkey from nation where n_regionkey = 1)",
    "filter_not_in_subquery": "c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)",
    "filter_not_in_subquery_null": "c_nationkey not in (select nullif(n_nationkey, 4) from nation)",
    "filter_exists": "exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "filter_not_exists": "not exists (select 1 from orders where o_custkey = c_custkey)",
}.items():
    sql(_name, f"select c_custkey, c_name from customer where {_where}")
sql("filter_empty_in", "select c_custkey from customer where c_nationkey not in ()", "select c_custkey from customer")
sql("filter_empty_in_none", "select c_custkey from customer where c_nationkey in ()", "select c_custkey from customer where false")
sql("filter_bool_equals_int", "select c_custkey from customer where (c_nationkey > 5) = 1", "select c_custkey from customer where c_nationkey > 5")

# -- joins --------------------------------------------------------------------------------------

sql("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
sql("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
frames("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)", lambda t: t("customer").join(t("orders"), [("c_custkey", "o_custkey")], "semi").select_columns("c_custkey"))
frames("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", lambda t: t("customer").join(t("orders"), [("c_custkey", "o_custkey")], "anti").select_columns("c_custkey"))
sql("join_cross", "select r_name, n_name from region cross join nation")
sql("join_multi_key", "select a.l_orderkey, a.l_linenumber, b.l_suppkey as other from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
frames(
    "join_null_safe",
    "select a.n_nationkey as x, b.n_nationkey as y from (select n_nationkey, nullif(n_regionkey, 2) as k from nation) a join (select n_nationkey, nullif(n_regionkey, 2) as k from nation) b on a.k is not distinct from b.k",
    lambda t: t("nation").select(x="n_nationkey", k="nullif(n_regionkey, 2)").join(t("nation").select(y="n_nationkey", j="nullif(n_regionkey, 2)"), [("k", "j")], null_safe=True).select_columns("x", "y"),
)
frames(
    "join_options",
    "select c_name, n_name from customer join nation on c_nationkey = n_nationkey",
    lambda t: t("customer").join(t("nation"), [("c_nationkey", "n_nationkey")], options=JoinOptions("hash", memory_limit_bytes=1 << 20)).select_columns("c_name", "n_name"),
)
sql("join_null_keys", "select a.n_nationkey as x, b.n_nationkey as y from (select n_nationkey, nullif(n_regionkey, 2) as k from nation) a join (select n_nationkey, nullif(n_regionkey, 2) as k from nation) b on a.k = b.k")
sql("join_theta", "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey")
sql("join_left_extra_on", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000")
sql("join_many_to_many", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey")
sql("join_comma_three_way", "select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey")
sql("join_nested", "select c_name, n_name, r_name from customer left join (nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey")
sql("join_no_match", "select c_custkey, n_name from customer join nation on c_custkey = -n_nationkey - 1")
sql("join_right", "select n_name, c_custkey from customer right join nation on c_nationkey = n_nationkey")
sql("join_full", "select n_name, s_name from nation full join supplier on s_nationkey = n_nationkey")

# -- aggregates ---------------------------------------------------------------------------------

sql("agg_count_star", "select count(*) as n from lineitem")
sql("agg_count_col", "select count(nullif(l_linenumber, 1)) as n from lineitem")
sql("agg_count_distinct", "select count(distinct l_suppkey) as n from lineitem")
sql("agg_sum", "select sum(l_linenumber) as n, cast(sum(cast(l_quantity as decimal(15,2))) as double) as q from lineitem", "select cast(sum(l_linenumber) as bigint) as n, cast(sum(cast(l_quantity as decimal(15,2))) as double) as q from lineitem")
sql("agg_sum_distinct", "select sum(distinct l_suppkey) as n from lineitem", "select cast(sum(distinct l_suppkey) as bigint) as n from lineitem")
sql("agg_sum_empty", "select sum(l_linenumber) as n from lineitem where l_orderkey < 0", "select cast(sum(l_linenumber) as bigint) as n from lineitem where l_orderkey < 0")
sql("agg_total", "select total(l_linenumber) as n from lineitem", "select cast(coalesce(sum(l_linenumber), 0) as double) as n from lineitem")
sql("agg_total_empty", "select total(l_linenumber) as n from lineitem where l_orderkey < 0", "select cast(0 as double) as n")
sql("agg_total_distinct", "select total(distinct l_linenumber) as n from lineitem", "select cast(sum(distinct l_linenumber) as double) as n from lineitem")
sql("agg_avg", "select round(avg(l_linenumber), 6) as a from lineitem")
sql("agg_avg_distinct", "select round(avg(distinct l_linenumber), 6) as a from lineitem")
sql(
    "agg_avg_decimal",
    "select l_returnflag, cast(avg(cast(l_extendedprice as decimal(15,2))) as double) as a from lineitem group by l_returnflag",
    "select l_returnflag, cast(cast(round(sum(cast(l_extendedprice as decimal(15,2))) / count(*), 2) as decimal(15,2)) as double) as a from lineitem group by l_returnflag",
)
sql("agg_decimal_types", "select typeof(s) as s, typeof(a) as a, typeof(t) as t from (select sum(x) as s, avg(x) as a, total(x) as t from (select cast(1 as decimal(10,2)) as x) d) e", "select 'decimal(10,2)' as s, 'decimal(10,2)' as a, 'decimal(10,2)' as t")
sql("agg_sum_decimal", "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as s, cast(total(cast(l_tax as decimal(15,2))) as double) as t from lineitem group by l_returnflag", "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as s, cast(sum(cast(l_tax as decimal(15,2))) as double) as t from lineitem group by l_returnflag")
sql("agg_min_max", "select min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderkey) as first, max(o_orderkey) as last from orders")
sql("agg_min_max_text", "select min(c_mktsegment) as lo, max(c_mktsegment) as hi from customer")
sql("agg_count_nulls", "select sum(case when c_nationkey is null then 1 else 0 end) as n, count(*) as rows from customer where c_custkey < 0", "select 0 as n, 0 as rows")
sql("agg_sum_case_nulls", "select sum(case when nullif(n_regionkey, 2) is null then 1 else 0 end) as n from nation", "select cast(sum(case when nullif(n_regionkey, 2) is null then 1 else 0 end) as bigint) as n from nation")
sql("agg_group_concat", "select n_regionkey, group_concat(n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
sql("agg_group_concat_separator", "select n_regionkey, group_concat(n_name, ' | ') as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ' | ' order by n_name) as names from nation group by n_regionkey")
sql("agg_group_concat_distinct", "select group_concat(distinct c_mktsegment) as names from customer", "select string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as names from customer")
sql("agg_expr_over_agg", "select count(*) + 1 as n, sum(l_linenumber) / count(l_orderkey) as per from lineitem", "select count(*) + 1 as n, cast(sum(l_linenumber) // count(l_orderkey) as bigint) as per from lineitem")
TEXTS = "(select case when o_orderkey % 3 = 0 then ' ' || cast(o_orderkey as varchar) || ' ' when o_orderkey % 3 = 1 then o_orderstatus end as x from orders) d"
NUMBERS = f"(select coalesce(try_cast(trim(x) as double), 0) as x from {TEXTS} where x is not null) e"
sql("agg_sum_text_coercion", f"select sum(x) as s, total(x) as t, avg(x) as a, sum(distinct x) as d from {TEXTS}", f"select sum(x) as s, sum(x) as t, avg(x) as a, sum(distinct x) as d from {NUMBERS}")
sql("group_by_one", "select l_returnflag, count(*) as n from lineitem group by l_returnflag")
sql("group_by_multi", "select l_returnflag, l_linestatus, count(*) as n, min(l_shipdate) as first from lineitem group by l_returnflag, l_linestatus")
sql("group_by_null_key", "select nullif(n_regionkey, 2) as k, count(*) as n from nation group by nullif(n_regionkey, 2)")
sql("having_agg", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
sql("having_subquery", "select n_regionkey, count(*) as n from nation group by n_regionkey having count(*) >= (select count(*) from region)")
sql("agg_many_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")

# -- sort and limit -----------------------------------------------------------------------------

# whole sorts; the place of each row makes the order part of the result
for _name, _keys, _oracle in (
    ("order_by_asc_nulls_last", "k asc nulls last", "k asc nulls last"),
    ("order_by_desc_nulls_first", "k desc nulls first", "k desc nulls first"),
    ("order_by_asc_nulls_first", "k asc nulls first", "k asc nulls first"),
    ("order_by_default_nulls", "k", "k asc nulls last"),
    ("order_by_desc_default_nulls", "k desc", "k desc nulls first"),
):
    _text = "select n_nationkey, k, row_number() over (order by {}, n_nationkey) as place from (select n_nationkey, nullif(n_regionkey, 0) as k from nation) d order by {}, n_nationkey"
    sql(_name, _text.format(_keys, _keys), _text.format(_oracle, _oracle))
sql("order_by_position", "select c_name, c_custkey from customer order by 2 desc")
sql("order_by_all", "select n_regionkey, n_nationkey from nation order by all")
sql(
    "order_by_cast_text",
    "select o_orderkey, k from (select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else o_orderstatus end as k from orders) d order by cast(k as integer), o_orderkey",
    "select o_orderkey, k from (select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else o_orderstatus end as k from orders) d order by try_cast(k as bigint) nulls last, o_orderkey",
)
sql("limit_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
sql("limit_zero", "select o_orderkey from orders limit 0")

# -- set operations -----------------------------------------------------------------------------

for _name, _op in {"union_distinct": "union", "union_all": "union all", "intersect": "intersect", "intersect_all": "intersect all", "except_distinct": "except", "except_all": "except all"}.items():
    sql(_name, f"select c_nationkey as k from customer {_op} select s_nationkey as k from supplier")
sql("set_op_chain", "select c_nationkey as k from customer union select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0")

# -- scalar functions ---------------------------------------------------------------------------

sql("arith_basic", "select l_linenumber + 1 as a, l_linenumber - 2 as b, l_linenumber * 3 as c, count(*) as n from lineitem group by l_linenumber")
sql("arith_int_div", "select o_orderkey, o_orderkey / 7 as d, -o_orderkey / 7 as m from orders", "select o_orderkey, o_orderkey // 7 as d, -(o_orderkey // 7) as m from orders")
sql("arith_div_zero_null", "select o_orderkey, o_orderkey / (o_orderkey % 5) as d from orders", "select o_orderkey, o_orderkey // nullif(o_orderkey % 5, 0) as d from orders")
sql("arith_float_div", "select o_orderkey, round(o_totalprice / 7, 4) as d, o_totalprice / 0 as z from orders", "select o_orderkey, round(o_totalprice / 7, 4) as d, cast(null as double) as z from orders")
sql("arith_mod", "select o_orderkey, o_orderkey % 7 as m from orders")
sql("unary_minus", "select c_custkey, -c_custkey as neg, +c_nationkey as pos from customer")
sql("shift_bits", "select n_nationkey, n_nationkey << 3 as l, n_nationkey >> 1 as r from nation")
sql("scalar_compare_bool_int", "select n_nationkey, (n_regionkey > 2) + 1 as big, coalesce(n_regionkey > 2, 0) as c from nation", "select n_nationkey, cast(n_regionkey > 2 as bigint) + 1 as big, cast(n_regionkey > 2 as bigint) as c from nation")
sql("scalar_logic", "select n_nationkey, n_regionkey and n_nationkey > 3 as a, n_regionkey or 0 as o, not n_regionkey as n from nation", "select n_nationkey, n_regionkey <> 0 and n_nationkey > 3 as a, n_regionkey <> 0 as o, n_regionkey = 0 as n from nation")
sql("scalar_in_between_value", "select n_nationkey, n_regionkey in (1, 2) as i, n_nationkey between 3 and 9 as b, nullif(n_regionkey, 1) is null as x from nation")
sql("abs", "select s_suppkey, abs(s_acctbal) as a from supplier")
sql("floor", "select s_suppkey, cast(floor(s_acctbal) as bigint) as f from supplier")
sql("coalesce", "select n_nationkey, coalesce(nullif(n_regionkey, 1), 99) as c from nation")
sql("nullif", "select n_nationkey, nullif(n_regionkey, 1) as c from nation")
sql("random_range", "select count(*) as n, sum(case when r >= 0 and r < 1 then 1 else 0 end) as inside from (select random() as r from nation) d", "select count(*) as n, count(*) as inside from nation")
sql("case_searched", "select c_custkey, case when c_acctbal < 0 then 'owes' when c_acctbal < 1000 then 'some' else 'rich' end as kind from customer")
sql("case_simple", "select n_nationkey, case n_regionkey when 0 then 'a' when 1 then 'b' end as kind from nation")
sql("cast_types", "select o_orderkey, cast(o_totalprice as bigint) as i, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d from orders", "select o_orderkey, cast(trunc(o_totalprice) as bigint) as i, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d from orders")
sql("date_add_month", "select o_orderkey, cast(o_orderdate as date) + interval '1' month as d from orders", "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as d from orders")
sql("date_intervals", "select o_orderkey, cast(o_orderdate as date) + interval '1' year as y, cast(o_orderdate as date) - interval '1-3' year to month as m, cast(o_orderdate as date) + interval 2 months 3 days as b from orders", "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 year as date) as y, cast(cast(o_orderdate as date) - interval 15 month as date) as m, cast(cast(o_orderdate as date) + interval 2 month + interval 3 day as date) as b from orders")
sql("date_sub_days", "select o_orderkey, cast(o_orderdate as date) - interval '90' day as d from orders", "select o_orderkey, cast(cast(o_orderdate as date) - interval 90 day as date) as d from orders")
query("date_diff", "select o_orderkey, cast(o_orderdate as date) - date '1995-01-01' as days from orders")(lambda t: t.orders.select("o_orderkey", S.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days")))
sql("date_literal_filter", "select o_orderkey from orders where o_orderdate < date '1995-03-15'")
sql("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
sql("correlated_scalar_subquery", "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as top from customer")
sql("correlated_min_filter", "select o_orderkey, o_custkey from orders o where o_totalprice = (select min(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.session import Session

    session = Session(spark)
    session.register("customer", read(spark, sf_dir, "customer"))
    return session.prepare("select c_custkey, c_name from customer where c_nationkey = ?2 and c_custkey > ?1").sql(20, 7)


QUERIES["prepared_params"] = _prepared
ORACLE["prepared_params"] = "select c_custkey, c_name from customer where c_nationkey = 7 and c_custkey > 20"

# -- end to end ---------------------------------------------------------------------------------

NET = f"{PRICE} * (1 - {DISC})"
#: The same in whole cents and hundredths, for the engine: unlike casts to decimals they format no text.
WHOLE = {c: f"cast(floor(l_{c} * 100 + 0.5) as bigint)" for c in ("extendedprice", "discount", "quantity")}
UNITS = f"{WHOLE['extendedprice']} * (100 - {WHOLE['discount']})"


def cents(c: str):
    """An amount that isn't negative in whole cents; unlike a cast to a decimal it formats no text."""
    return F.floor(F.col(c) * 100 + 0.5)


def exact_sum(units, scale: int):
    """The sum of whole 10**-scale units as a double, exact before its last rounding."""
    return (F.sum(units.cast("decimal(18,0)")) * F.lit(Decimal(1).scaleb(-scale))).cast("double")


def pricing_summary(t: Tables) -> DataFrame:
    price, disc, tax = cents("l_extendedprice"), cents("l_discount"), cents("l_tax")
    net = price * (100 - disc)
    sums = {"sum_qty": (cents("l_quantity"), 2), "sum_base_price": (price, 2), "sum_disc_price": (net, 4), "sum_charge": (net * (100 + tax), 6)}
    kept = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-12-01").cast("date") - F.expr("interval 90 days"))
    out = kept.groupBy("l_returnflag", "l_linestatus").agg(*(exact_sum(*v).alias(k) for k, v in sums.items()), F.round(exact_sum(disc, 2) / F.count("*"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
    return out.orderBy(S.order("l_returnflag"), S.order("l_linestatus"))


query(
    "pricing_summary",
    f"select l_returnflag, l_linestatus, cast(sum({QTY}) as double) as sum_qty, cast(sum({PRICE}) as double) as sum_base_price, cast(sum({NET}) as double) as sum_disc_price, cast(sum({NET} * (1 + {TAX})) as double) as sum_charge, cast(round(cast(sum({DISC}) as double) / count(*), 6) as double) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2 order by 1, 2",
)(pricing_summary)

def summed(name: str, rows: str, keys: list[str], oracle: str, order: tuple[str, ...] = (), limit: int | None = None, **sums: tuple[str, int]) -> None:
    """A query of the dialect whose rows are grouped and summed exactly; ``sums``: column and scale of each, ``order``: columns, - for descending."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.session import Session

        session = Session(spark)
        for t in TABLES:
            if t in rows:
                session.register(t, read(spark, sf_dir, t))
        out = session.sql(rows).groupBy(*keys).agg(*(exact_sum(F.col(c), scale).alias(n) for n, (c, scale) in sums.items()))
        out = out.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order)) if order else out
        return out.limit(limit) if limit is not None else out

    QUERIES[name], ORACLE[name] = run, oracle


summed(
    "shipping_priority",
    f"select l_orderkey, cast(o_orderdate as date) as o_date, {UNITS} as units from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15'",
    ["l_orderkey", "o_date"],
    f"select l_orderkey, cast(sum({NET}) as double) as revenue, cast(o_orderdate as date) as o_date from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10",
    ("-revenue", "l_orderkey"),
    10,
    revenue=("units", 4),
)
summed(
    "revenue_change",
    f"select {WHOLE['extendedprice']} * {WHOLE['discount']} as units from lineitem where l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    [],
    f"select cast(sum({PRICE} * {DISC}) as double) as revenue from lineitem where l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    revenue=("units", 4),
)
summed(
    "local_supplier_volume",
    f"select n_name, {UNITS} as units from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'",
    ["n_name"],
    f"select n_name, cast(sum({NET}) as double) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name",
    revenue=("units", 4),
)
sql("order_priority_checking", "select o_orderpriority, count(*) as n from orders where o_orderdate >= date '1993-07-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 40) group by o_orderpriority")
summed(
    "promotion_effect",
    f"select case when p_type like 'PROMO%' then {UNITS} else 0 end as promoted, {UNITS} as units from lineitem, part where l_partkey = p_partkey",
    [],
    f"select cast(sum(case when p_type like 'PROMO%' then {NET} else 0 end) as double) as promo, cast(sum({NET}) as double) as total_revenue from lineitem, part where l_partkey = p_partkey",
    promo=("promoted", 4),
    total_revenue=("units", 4),
)
summed(
    "returned_items",
    f"select c_custkey, c_name, {UNITS} as units from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey",
    ["c_custkey", "c_name"],
    f"select c_custkey, c_name, cast(sum({NET}) as double) as revenue from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name order by revenue desc, c_custkey limit 20",
    ("-revenue", "c_custkey"),
    20,
    revenue=("units", 4),
)
summed(
    "large_volume_customers",
    f"select c_name, o_orderkey, {WHOLE['quantity']} as units from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 150) and c_custkey = o_custkey and o_orderkey = l_orderkey",
    ["c_name", "o_orderkey"],
    "select c_name, o_orderkey, cast(sum(cast(l_quantity as decimal(15,2))) as double) as q from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 150) and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, o_orderkey",
    q=("units", 2),
)
