"""The 22 analytical queries as summations and lookups, each beside SQL with the same result.

The tables at hand lack some columns of the benchmark (a supply table, commit and receipt dates, ship
modes, containers, comments, phones); what stands in for them is said at each query. Amounts are
added exactly, as decimals, and become doubles at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import contains, ends_with, extract_year, money, share, starts_with, substr, yyyymmdd
from ..operators.semiring import beside, highest
from ..sources.text import read_parquet
from .coll import VALUE, Coll, emit, nested, rec, scalar

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Names of the two nations that queries ask for.
A, B = "NATION_15", "NATION_2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables as bags, each opened when it is first used; nation and region have fixed sizes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> Coll:
        if name not in NAMES:
            raise AttributeError(name)
        coll = read_parquet(self._spark, f"{self._dir}/{name}.parquet", small=name in ("region", "nation"))
        setattr(self, name, coll)
        return coll


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def partsupp(li: Coll) -> Coll:
    """Stands in for the supply table: for each part and supplier the quantity sold and the least unit price."""
    df = li.df.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum("l_quantity").alias("ps_availqty"), F.min(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("ps_supplycost"))
    return Coll(df, ["ps_partkey", "ps_suppkey"], ["ps_availqty", "ps_supplycost"], unique=True)


def between(c: Column, first: int, end: int) -> Column:
    """first <= c < end, days as integers."""
    return (c >= yyyymmdd(first)) & (c < yyyymmdd(end))


def revenue(p) -> Column:
    return money(p.l_extendedprice) * (1 - share(p.l_discount))


_PRICE, _DISCOUNT = "cast(l_extendedprice as decimal(12,2))", "cast(l_discount as decimal(4,2))"
_REVENUE = f"{_PRICE} * (1 - {_DISCOUNT})"
_PARTSUPP = """ps as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, sum(l_quantity) as ps_availqty,
  min(floor(l_extendedprice / l_quantity * 100) / 100) as ps_supplycost from lineitem group by all)"""


def query(sql: str):
    """Registers a query of the tables with its SQL."""

    def wrap(f: Callable[[Tables], Coll | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(tables(spark, sf_dir))
            return out.result() if isinstance(out, Coll) else out

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return wrap


@query(f"""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty,
  cast(sum({_PRICE}) as double) as sum_base_price, cast(sum({_REVENUE}) as double) as sum_disc_price,
  cast(sum({_REVENUE} * (1 + cast(l_tax as decimal(4,2)))) as double) as sum_charge, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def q1(t):
    """Pricing summary."""
    return t.lineitem.sum(lambda p: emit(
        {"l_returnflag": p.l_returnflag, "l_linestatus": p.l_linestatus},
        {"sum_qty": money(p.l_quantity), "sum_base_price": money(p.l_extendedprice), "sum_disc_price": revenue(p), "sum_charge": revenue(p) * (1 + share(p.l_tax)), "count_order": 1},
        when=p.l_shipdate <= yyyymmdd(19980902)))


def _q2(t, least: bool) -> Coll:
    ps = partsupp(t.lineitem)
    region = t.region.join_build("r_regionkey", lambda p: p.r_name == "EUROPE")
    nation = t.nation.join_probe(region, "n_regionkey", None, lambda v, p: emit({"n_nationkey": p.n_nationkey}, {"n_name": p.n_name}, unique=True))
    supp = t.supplier.join_probe(nation, "s_nationkey", None, lambda v, p: emit({"s_suppkey": p.s_suppkey}, {"s_acctbal": p.s_acctbal, "s_name": p.s_name, "n_name": v.n_name}, unique=True))
    parts = t.part.join_build("p_partkey", lambda p: (p.p_size == 15) & ends_with(p.p_type, "DARD"))
    offers = ps.sum(lambda p: emit({"ps_partkey": p.ps_partkey, "ps_suppkey": p.ps_suppkey}, {"ps_supplycost": p.ps_supplycost}, when=p.look(parts, p.ps_partkey).found & p.look(supp, p.ps_suppkey).found, unique=True))
    cost = F.col("ps_supplycost") if least else money(F.col("ps_supplycost"))
    offers = beside(offers, ["ps_partkey"], "wanted", F.min(cost) if least else F.sum(cost))

    def best(p):
        s = p.look(supp, p.ps_suppkey)
        key = {"s_acctbal": s.s_acctbal, "s_name": s.s_name, "n_name": s.n_name, "p_partkey": p.ps_partkey}
        return emit(key, when=s.found & (p.wanted == (p.ps_supplycost if least else money(p.ps_supplycost))), unique=True)

    return offers.sum(best)


_Q2 = f"""with {_PARTSUPP},
o as (select s_acctbal, s_name, n_name, ps_partkey as p_partkey, ps_supplycost as cost from ps join supplier on s_suppkey = ps_suppkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey join part on p_partkey = ps_partkey
  where r_name = 'EUROPE' and p_size = 15 and p_type like '%DARD')
select s_acctbal, s_name, n_name, p_partkey from o join """


@query(_Q2 + "(select p_partkey, min(cost) as best from o group by 1) using (p_partkey) where cost = best")
def q2(t):
    """Suppliers with the least cost of a part; no addresses here."""
    return _q2(t, least=True)


@query(_Q2 + "(select p_partkey, sum(cast(cost as decimal(12,2))) as best from o group by 1) using (p_partkey) where cast(cost as decimal(12,2)) = best")
def q2_literal(t):
    """As q2, with costs added up where the least is meant: parts with one supplier only."""
    return _q2(t, least=False)


@query(f"""select l_orderkey, o_orderdate, cast(sum({_REVENUE}) as double) as revenue from lineitem join orders on o_orderkey = l_orderkey
  join customer on c_custkey = o_custkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by all""")
def q3(t):
    """Unshipped orders of a segment."""
    cust = t.customer.join_build("c_custkey", lambda p: p.c_mktsegment == "BUILDING")
    orders = t.orders.join_probe(cust, "o_custkey", lambda p: p.o_orderdate < yyyymmdd(19980315), lambda v, p: emit({"o_orderkey": p.o_orderkey}, {"o_orderdate": p.o_orderdate}, unique=True))
    return t.lineitem.join_probe(orders, "l_orderkey", lambda p: p.l_shipdate > yyyymmdd(19980315), lambda v, p: emit({"l_orderkey": p.l_orderkey, "o_orderdate": v.o_orderdate}, {"revenue": revenue(p)}))


@query("""select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '1996-10-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1""")
def q4(t):
    """Orders with a returned line (for a late one) by priority."""
    late = t.lineitem.join_build("l_orderkey", lambda p: p.l_returnflag == "R")
    return t.orders.join_probe(late, "o_orderkey", lambda p: between(p.o_orderdate, 19960701, 19961001), lambda v, p: emit({"o_orderpriority": p.o_orderpriority}, {"order_count": 1}))


@query(f"""select n_name, cast(sum({_REVENUE}) as double) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by 1""")
def q5(t):
    """Revenue within nations of a region."""
    region = t.region.join_build("r_regionkey", lambda p: p.r_name == "ASIA")
    nation = t.nation.join_probe(region, "n_regionkey", None, lambda v, p: emit({"n_nationkey": p.n_nationkey}, {"n_name": p.n_name}, unique=True))
    cust = t.customer.join_probe(nation, "c_nationkey", None, lambda v, p: emit({"c_custkey": p.c_custkey}, {"n_name": v.n_name, "c_nationkey": p.c_nationkey}, unique=True))
    orders = t.orders.join_probe(cust, "o_custkey", lambda p: between(p.o_orderdate, 19960101, 19970101), lambda v, p: emit({"o_orderkey": p.o_orderkey}, {"n_name": v.n_name, "c_nationkey": v.c_nationkey}, unique=True))
    supp = t.supplier.sum(lambda p: emit({"s_suppkey": p.s_suppkey, "s_nationkey": p.s_nationkey}, unique=True))
    return t.lineitem.join_probe(orders, "l_orderkey", None, lambda v, p: emit({"n_name": v.n_name}, {"revenue": revenue(p)}, when=p.look(supp, p.l_suppkey, v.c_nationkey).found))


@query(f"""select cast(coalesce(sum({_PRICE} * {_DISCOUNT}), 0) as double) as revenue from lineitem
where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24""")
def q6(t):
    """Revenue of small discounts."""
    return t.lineitem.sum(lambda p: rec(
        revenue=money(p.l_extendedprice) * share(p.l_discount),
        when=between(p.l_shipdate, 19960101, 19970101) & (p.l_discount >= 0.05) & (p.l_discount <= 0.07) & (p.l_quantity < 24.0)))


@query(f"""select s.n_name as supp_nation, c.n_name as cust_nation, cast(year(l_shipdate) as bigint) as l_year, cast(sum({_REVENUE}) as double) as revenue
from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation s on s.n_nationkey = s_nationkey join nation c on c.n_nationkey = c_nationkey
where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1998-01-01'
  and ((s.n_name = '{A}' and c.n_name = '{B}') or (s.n_name = '{B}' and c.n_name = '{A}')) group by all""")
def q7(t):
    """Trade between two nations by year."""
    nation = t.nation.join_build("n_nationkey", lambda p: (p.n_name == A) | (p.n_name == B), ["n_name"])
    cust = t.customer.join_probe(nation, "c_nationkey", None, lambda v, p: emit({"c_custkey": p.c_custkey}, {"n_name": v.n_name}, unique=True))
    orders = t.orders.join_probe(cust, "o_custkey", None, lambda v, p: emit({"o_orderkey": p.o_orderkey}, {"n_name": v.n_name}, unique=True))
    supp = t.supplier.join_probe(nation, "s_nationkey", None, lambda v, p: emit({"s_suppkey": p.s_suppkey}, {"n_name": v.n_name}, unique=True))

    def body(p):
        s, o = p.look(supp, p.l_suppkey), p.look(orders, p.l_orderkey)
        pair = ((o.n_name == A) & (s.n_name == B)) | ((o.n_name == B) & (s.n_name == A))
        key = {"supp_nation": s.n_name, "cust_nation": o.n_name, "l_year": extract_year(p.l_shipdate)}
        return emit(key, {"revenue": revenue(p)}, when=o.found & s.found & between(p.l_shipdate, 19960101, 19980101) & pair)

    return t.lineitem.sum(body)


@query(f"""select cast(year(o_orderdate) as bigint) as o_year,
  cast(coalesce(sum({_REVENUE}) filter (where s.n_name = '{A}'), 0) as double) / cast(sum({_REVENUE}) as double) as mkt_share
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation c on c.n_nationkey = c_nationkey join region on r_regionkey = c.n_regionkey join nation s on s.n_nationkey = s_nationkey
where r_name = 'AMERICA' and p_type = 'ECONOMY' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by 1""")
def q8(t):
    """A nation's share of a region's market by year."""
    region = t.region.join_build("r_regionkey", lambda p: p.r_name == "AMERICA")
    there = t.nation.join_probe(region, "n_regionkey", None, lambda v, p: emit({"n_nationkey": p.n_nationkey}, unique=True))
    nation = t.nation.join_build("n_nationkey", out=["n_name"])
    supp = t.supplier.join_build("s_suppkey", out=["s_nationkey"])
    cust = t.customer.sum(lambda p: emit({"c_custkey": p.c_custkey}, {"c_nationkey": p.c_nationkey}, unique=True))
    parts = t.part.join_build("p_partkey", lambda p: p.p_type == "ECONOMY")
    orders = t.orders.join_build("o_orderkey", lambda p: between(p.o_orderdate, 19960101, 19980101), ["o_custkey", "o_orderdate"])

    def body(v, p):
        o = p.look(orders, p.l_orderkey)
        c = p.look(cust, o.o_custkey)
        s = p.look(nation, p.look(supp, p.l_suppkey).s_nationkey)
        here = F.when(s.n_name == A, revenue(p)).otherwise(F.lit(0))
        return emit({"o_year": extract_year(o.o_orderdate)}, {"a": here, "b": revenue(p)}, when=o.found & p.look(there, c.c_nationkey).found)

    shares = t.lineitem.join_probe(parts, "l_partkey", None, body)
    return shares.finish(lambda p: {"o_year": p.o_year, "mkt_share": p.a.cast("double") / p.b.cast("double")})


@query(f"""with {_PARTSUPP}
select n_name as nation, cast(year(o_orderdate) as bigint) as o_year,
  cast(sum({_REVENUE} - cast(ps_supplycost as decimal(12,2)) * cast(l_quantity as decimal(12,2))) as double) as sum_profit
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join ps on ps_partkey = l_partkey and ps_suppkey = l_suppkey
  join orders on o_orderkey = l_orderkey join nation on n_nationkey = s_nationkey where contains(p_name, 'blue') group by all""")
def q9(t):
    """Profit by nation and year, on parts with a word in their name."""
    nation = t.nation.join_build("n_nationkey", out=["n_name"])
    supp = t.supplier.sum(lambda p: emit({"s_suppkey": p.s_suppkey}, {"n_name": p.look(nation, p.s_nationkey).n_name}, unique=True))
    parts = t.part.join_build("p_partkey", lambda p: contains(p.p_name, "blue"))
    ps = partsupp(t.lineitem).join_probe(parts, "ps_partkey", None, lambda v, p: emit({"ps_partkey": p.ps_partkey, "ps_suppkey": p.ps_suppkey}, {"n_name": p.look(supp, p.ps_suppkey).n_name, "ps_supplycost": p.ps_supplycost}, unique=True))
    orders = t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey}, {"o_orderdate": p.o_orderdate}, unique=True))
    lines = t.lineitem.where(lambda p: p.look(parts, p.l_partkey).found)

    def body(p):
        s = p.look(ps, p.l_partkey, p.l_suppkey)
        key = {"nation": s.n_name, "o_year": extract_year(p.look(orders, p.l_orderkey).o_orderdate)}
        return emit(key, {"sum_profit": revenue(p) - money(s.ps_supplycost) * money(p.l_quantity)}, when=s.found)

    return lines.sum(body)


@query(f"""select c_custkey, c_name, c_acctbal, n_name, cast(sum({_REVENUE}) as double) as revenue
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
where o_orderdate >= timestamp '1996-10-01' and o_orderdate < timestamp '1997-01-01' and l_returnflag = 'R' group by all""")
def q10(t):
    """Customers' returned revenue."""
    nation = t.nation.join_build("n_nationkey", out=["n_name"])
    cust = t.customer.join_build("c_custkey", out=["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    orders = t.orders.join_probe(cust, "o_custkey", lambda p: between(p.o_orderdate, 19961001, 19970101), lambda v, p: emit(
        {"o_orderkey": p.o_orderkey}, {"c_custkey": v.c_custkey_, "c_name": v.c_name, "c_acctbal": v.c_acctbal, "n_name": p.look(nation, v.c_nationkey).n_name}, unique=True))
    return t.lineitem.join_probe(orders, "l_orderkey", lambda p: p.l_returnflag == "R", lambda v, p: emit(
        {"c_custkey": v.c_custkey, "c_name": v.c_name, "c_acctbal": v.c_acctbal, "n_name": v.n_name}, {"revenue": revenue(p)}))


@query(f"""with {_PARTSUPP}, v as (select ps_partkey, sum(cast(ps_supplycost as decimal(12,2)) * cast(ps_availqty as decimal(12,2))) as v
  from ps join supplier on s_suppkey = ps_suppkey join nation on n_nationkey = s_nationkey where n_name = '{A}' group by 1)
select ps_partkey, cast(v as double) as value from v where v > (select sum(v) * 0.0001 from v)""")
def q11(t):
    """Parts that make up a share of a nation's stock: a total of the sums by part, so that both come from one pass."""
    nation = t.nation.join_build("n_nationkey", lambda p: p.n_name == A)
    supp = t.supplier.join_probe(nation, "s_nationkey", None, lambda v, p: emit({"s_suppkey": p.s_suppkey}, unique=True))

    ps = partsupp(t.lineitem.where(lambda p: p.look(supp, p.l_suppkey).found))
    parts = ps.sum(lambda p: emit({"ps_partkey": p.ps_partkey}, money(p.ps_supplycost) * money(p.ps_availqty)))
    least = parts.sum(lambda p: scalar(p.count)).scalar() * F.lit(0.0001).cast("decimal(4,4)")
    return parts.sum(lambda p: emit({"ps_partkey": p.ps_partkey, VALUE: p.count.cast("double")}, when=p.count > least, unique=True))


@query("""select l_linestatus, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high_line_count,
  cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end) as bigint) as low_line_count
from lineitem join orders on o_orderkey = l_orderkey
where l_returnflag in ('A', 'R') and l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' group by 1""")
def q12(t):
    """Urgent and other orders by line status (for ship mode): a nested map by order and status, gone through."""
    lines = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, nested({"l_linestatus": p.l_linestatus}, {"lines": 1}), when=p.l_returnflag.isin("A", "R") & between(p.l_shipdate, 19960101, 19970101)))
    urgent = t.orders.join_build("o_orderkey", out=["o_orderpriority"])

    def body(p):
        high = p.look(urgent, p.l_orderkey).o_orderpriority.isin("1-URGENT", "2-HIGH")
        return p.inner.sum(lambda q: emit({"l_linestatus": q.l_linestatus}, {"high_line_count": F.when(high, q.lines).otherwise(0), "low_line_count": F.when(high, 0).otherwise(q.lines)}))

    return lines.nest("l_linestatus").sum(body)


@query("""select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count
  from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' group by 1) group by 1""")
def q13(t):
    """How many customers have how many urgent orders (for those without a phrase in their comment), none included."""
    orders = t.orders.sum(lambda p: emit({"o_custkey": p.o_custkey}, {"orders": 1}, when=p.o_orderpriority == "1-URGENT"))
    return t.customer.sum(lambda p: emit({"c_count": p.look(orders, p.c_custkey).get("orders", 0).cast("long")}, {"custdist": 1}))


@query(f"""select 100.0 * cast(coalesce(sum({_REVENUE}) filter (where p_type like 'PROMO%'), 0) as double) / cast(sum({_REVENUE}) as double) as promo_revenue
from lineitem left join part on p_partkey = l_partkey where l_shipdate >= timestamp '1996-09-01' and l_shipdate < timestamp '1996-10-01'""")
def q14(t):
    """Share of promoted parts: a guard inside a value."""
    promo = t.part.join_build("p_partkey", lambda p: starts_with(p.p_type, "PROMO"))
    sums = t.lineitem.sum(lambda p: rec(a=F.when(p.look(promo, p.l_partkey).flag(), revenue(p)).otherwise(0), b=revenue(p), when=between(p.l_shipdate, 19960901, 19961001)))
    return sums.finish(lambda p: {"promo_revenue": 100.0 * p.a.cast("double") / p.b.cast("double")})


@query(f"""with r as (select l_suppkey, sum({_REVENUE}) as total from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by 1)
select s_suppkey, s_name, cast(total as double) as total_revenue from r join supplier on s_suppkey = l_suppkey where total = (select max(total) from r)""")
def q15(t):
    """The suppliers with the greatest revenue; the greatest is computed, not given."""
    # Keys aren't null; said here, it makes both uses of the sums one plan, whose shuffle Spark shares.
    sums = t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, {"total": revenue(p)}, when=between(p.l_shipdate, 19960101, 19960401) & p.l_suppkey.isNotNull()))
    most = highest(sums, [], "total")
    supp = t.supplier.join_build("s_suppkey", out=["s_name"])
    return sums.sum(lambda p: emit({"s_suppkey": p.l_suppkey, "s_name": p.look(supp, p.l_suppkey).s_name, "total_revenue": p.total.cast("double")}, when=p.total == most.scalar("total"), unique=True))


@query(f"""with {_PARTSUPP}
select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from ps join part on p_partkey = ps_partkey
where p_brand <> 'Brand#12' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
  and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by all""")
def q16(t):
    """Distinct suppliers by kind of part, but for those in debt (for complaints)."""
    parts = t.part.join_build("p_partkey", lambda p: (p.p_brand != "Brand#12") & ~starts_with(p.p_type, "MEDIUM") & p.p_size.isin(49, 14, 23, 45, 19, 3, 36, 9), ["p_brand", "p_type", "p_size"])
    bad = t.supplier.join_build("s_suppkey", lambda p: p.s_acctbal < 0)
    ps = partsupp(t.lineitem.where(lambda p: p.look(parts, p.l_partkey).found & p.look(bad, p.l_suppkey).missing))
    sets = ps.join_probe(parts, "ps_partkey", None, lambda v, p: emit(
        {"p_brand": v.p_brand, "p_type": v.p_type, "p_size": v.p_size}, nested({"ps_suppkey": p.ps_suppkey})))
    return sets.sum(lambda p: emit({"p_brand": p.p_brand, "p_type": p.p_type, "p_size": p.p_size}, {"supplier_cnt": 1}))


@query(f"""select cast(coalesce(sum({_PRICE}), 0) as double) / 7.0 as avg_yearly from lineitem join
  (select l_partkey, sum(l_quantity) / count(*) as average from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#23' group by 1) using (l_partkey)
where 0.2 * average > l_quantity""")
def q17(t):
    """Small orders of a brand's parts: a self-join through an aggregate."""
    parts = t.part.join_build("p_partkey", lambda p: p.p_brand == "Brand#23")
    sums = t.lineitem.join_probe(parts, "l_partkey", None, lambda v, p: emit({"l_partkey": p.l_partkey}, {"quantity": p.l_quantity, "lines": 1}))
    total = t.lineitem.join_probe(sums, "l_partkey", None, lambda v, p: scalar(money(p.l_extendedprice), when=0.2 * (v.quantity / v.lines) > p.l_quantity))
    return total.finish(lambda p: {"avg_yearly": p.count.cast("double") / 7.0})


@query("""select c_name, o_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as quantitysum
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 300) group by all""")
def q18(t):
    """Large orders."""
    sums = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"quantity": p.l_quantity}))
    large = sums.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, when=p.quantity > 300, unique=True))
    cust = t.customer.join_build("c_custkey", out=["c_name"])
    orders = t.orders.join_probe(cust, "o_custkey", lambda p: p.look(large, p.o_orderkey).found, lambda v, p: emit(
        {"key": p.o_orderkey}, {"c_name": v.c_name, "o_custkey": p.o_custkey, "o_orderkey": p.o_orderkey, "o_orderdate": p.o_orderdate, "o_totalprice": p.o_totalprice}, unique=True))
    return t.lineitem.join_probe(orders, "l_orderkey", None, lambda v, p: emit({c: v.field(c) for c in orders.values}, {"quantitysum": p.l_quantity}))


_Q19 = (("Brand#12", 15, 1, 11, ("SMALL", "PROMO")), ("Brand#23", 25, 10, 20, ("MEDIUM", "STANDARD")), ("Brand#4", 35, 20, 30, ("LARGE", "ECONOMY")))


@query(f"select cast(coalesce(sum({_REVENUE}), 0) as double) as revenue from lineitem join part on p_partkey = l_partkey where " + " or ".join(
    f"(p_brand = '{b}' and p_size between 1 and {s} and l_quantity between {lo} and {hi} and p_type in {k})" for b, s, lo, hi, k in _Q19))
def q19(t):
    """Revenue under one of three sets of conditions over both sides (part types for containers)."""
    any_ = lambda conds: conds[0] | conds[1] | conds[2]
    parts = t.part.join_build("p_partkey", lambda p: any_([(p.p_brand == b) & p.p_size.between(1, s) & p.p_type.isin(*k) for b, s, _, _, k in _Q19]), ["p_brand"])
    return t.lineitem.join_probe(parts, "l_partkey", None, lambda v, p: rec(revenue=revenue(p), when=any_([(v.p_brand == b) & p.l_quantity.between(lo, hi) for b, _, lo, hi, _ in _Q19])))


@query(f"""with {_PARTSUPP}, sold as (select l_partkey, l_suppkey, 0.5 * sum(l_quantity) as half from lineitem
  where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' group by all)
select s_name from supplier join nation on n_nationkey = s_nationkey where n_name = '{A}' and s_suppkey in
  (select ps_suppkey from ps join sold on l_partkey = ps_partkey and l_suppkey = ps_suppkey join part on p_partkey = ps_partkey where starts_with(p_name, 'blue anvil') and ps_availqty > half)""")
def q20(t):
    """Suppliers with much more of a part than they have shipped."""
    parts = t.part.join_build("p_partkey", lambda p: starts_with(p.p_name, "blue anvil"))
    nation = t.nation.join_build("n_nationkey", lambda p: p.n_name == A)
    supp = t.supplier.join_build("s_suppkey", lambda p: p.look(nation, p.s_nationkey).found)
    sold = t.lineitem.sum(lambda p: emit({"l_partkey": p.l_partkey, "l_suppkey": p.l_suppkey}, {"half": 0.5 * p.l_quantity},
        when=p.look(parts, p.l_partkey).found & p.look(supp, p.l_suppkey).found & between(p.l_shipdate, 19960101, 19970101)))

    def excess(p):
        s = p.look(sold, p.ps_partkey, p.ps_suppkey)
        return s.found & (p.ps_availqty > s.half)

    mine = t.lineitem.where(lambda p: p.look(parts, p.l_partkey).found & p.look(supp, p.l_suppkey).found)
    much = partsupp(mine).join_build("ps_suppkey", excess)
    return t.supplier.join_probe(much, "s_suppkey", None, lambda v, p: emit({"s_name": p.s_name}, unique=True))


def _q21(t, distinct: bool) -> Coll:
    nation = t.nation.join_build("n_nationkey", lambda p: p.n_name == A)
    supp = t.supplier.join_probe(nation, "s_nationkey", None, lambda v, p: emit({"s_suppkey": p.s_suppkey}, {"s_name": p.s_name}, unique=True))
    orders = t.orders.join_build("o_orderkey", lambda p: p.o_orderstatus == "F")
    # One pass: of each order, the suppliers (or lines) and the late ones.
    late = lambda p: p.l_returnflag == "R"
    if distinct:
        pairs = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey, "l_suppkey": p.l_suppkey}, {"late": late(p)}))
        sizes = pairs.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"all": 1, "late": p.late.cast("long")}))
    else:
        sizes = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"all": 1, "late": late(p).cast("long")}))

    def body(p):
        s, n = p.look(supp, p.l_suppkey), p.look(sizes, p.l_orderkey)
        return emit({"s_name": s.s_name}, {"numwait": 1}, when=s.found & p.look(orders, p.l_orderkey).found & n.found & late(p) & (n.field("all") > 1) & ~(n.late > 1))

    return t.lineitem.sum(body)


_Q21 = """with n as (select l_orderkey, count({0} l_suppkey) as whole, count({0} l_suppkey) filter (where l_returnflag = 'R') as late from lineitem group by 1)
select s_name, count(*) as numwait from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
  join orders on o_orderkey = l_orderkey join n using (l_orderkey)
where n_name = '{1}' and o_orderstatus = 'F' and l_returnflag = 'R' and whole > 1 and late <= 1 group by 1"""


@query(_Q21.format("distinct", A))
def q21(t):
    """Suppliers who alone were late (returned, for late) in orders of several suppliers."""
    return _q21(t, distinct=True)


@query(_Q21.format("", A))
def q21_literal(t):
    """As q21, with lines counted where suppliers are meant."""
    return _q21(t, distinct=False)


_CODES = (13, 8, 23, 4, 0, 18, 17)


@query(f"""with c as (select * from customer where c_nationkey in {_CODES})
select cast(c_nationkey as varchar) as cntrycode, count(*) as numcust, cast(sum(cast(c_acctbal as decimal(12,2))) as double) as totalacctbal from c
where c_acctbal > (select cast(sum(cast(c_acctbal as decimal(12,2))) as double) / count(*) from c where c_acctbal > 0)
  and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by 1""")
def q22(t):
    """Customers above the average balance without urgent orders, by nation (for the phone's country code)."""
    has = t.orders.join_build("o_custkey", lambda p: p.o_orderpriority == "1-URGENT")
    here = lambda p: p.c_nationkey.isin(*_CODES)
    sums = t.customer.sum(lambda p: rec(balance=money(p.c_acctbal), n=1, when=(p.c_acctbal > 0.0) & here(p)))
    average = sums.finish(lambda p: {"average": p.balance.cast("double") / p.n})
    return t.customer.sum(lambda p: emit({"cntrycode": substr(p.c_nationkey.cast("string"), 0, 1)}, {"numcust": 1, "totalacctbal": money(p.c_acctbal)},
        when=p.look(has, p.c_custkey).missing & (p.c_acctbal > average.scalar("average")) & here(p)))
