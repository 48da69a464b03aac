"""One small query for each operator of the language, beside SQL with the same result."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import relalg, semiring
from ..sources.text import Result, date, from_rows, read_csv, string
from .coll import Coll, both, emit, nested, rec, scalar, vector
from .declared import Session, declared
from .tpch import revenue, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query of (tables, session) with its SQL."""

    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(tables(spark, sf_dir), spark)
            return out.result() if isinstance(out, Coll) else out

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return wrap


_PRICE = "cast(l_extendedprice as decimal(12,2))"


# Scans and sinks


def _place(spark: SparkSession) -> str:
    """A fresh path that driver and executors share: below the checkpoint folder where one is set. Removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/inventory-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001, S110  the session may be gone already
        pass


def _written(spark: SparkSession, rows: DataFrame) -> str:
    path = _place(spark)
    rows.write.csv(path, sep="|")
    return path


@query("select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_totalprice, substr(o_orderpriority, 1, 5) as o_orderpriority from orders")
def s1_text_scan(t, spark):
    """Delimited text with a trailing delimiter, declared types, and cut strings."""
    rows = t.orders.df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice", "o_orderpriority", F.lit(None).cast("string"))
    orders = read_csv(spark, _written(spark, rows), {"o_orderkey": int, "o_orderdate": date, "o_totalprice": float, "o_orderpriority": string(5)})
    return orders.result().withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def s2_distinct_rows(t, spark):
    """Some columns of a delimited text, rows as keys of a map."""
    path = _written(spark, t.lineitem.df.select("l_orderkey", "l_returnflag", "l_quantity", "l_linestatus"))
    record = {"l_orderkey": int, "l_returnflag": string(1), "l_quantity": float, "l_linestatus": string(1)}
    return read_csv(spark, path, record, include=["l_returnflag", "l_linestatus"], distinct=True)


@query("select o_custkey, sum(n) as lines from (select l_orderkey, count(*) as n from lineitem group by 1) join orders on o_orderkey = l_orderkey group by 1")
def s6_result_as_input(t, spark):
    """A declared query's result, written once and bound to a name, is an input of the next."""

    @declared(li={"l_orderkey": int})
    def lines(li):
        return li.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"n": 1}))

    @declared(counts={"l_orderkey": int, "n": int}, orders={"o_orderkey": int, "o_custkey": int})
    def by_customer(counts, orders):
        index = orders.join_build("o_orderkey", out=["o_custkey"])
        return counts.sum(lambda p: emit({"o_custkey": p.look(index, p.l_orderkey).o_custkey}, {"lines": p.n}))

    session = Session(spark, {"lineitem": t.lineitem, "orders": t.orders})
    session.run(lines, name="counts", path=_place(spark), li="lineitem")
    return session.run(by_customer)


@query("select cast(sum(l_quantity) as double) as total from lineitem")
def s7_scalar(t, spark):
    """A total as a number on the client, and back as a row."""
    total = Result(t.lineitem.sum(lambda p: scalar(p.l_quantity))).scalar()
    return spark.createDataFrame([(total,)], "total double")


@query("select r_name, count(*) as nations, 'AFRICA' = r_name as first_ from nation join region on r_regionkey = n_regionkey group by all")
def s9_export(t, spark):
    """A result as a dictionary on the client (a map of fixed size), changed there, and bound again."""
    names = t.region.join_build("r_regionkey", out=["r_name"], checked=True)
    counts = t.nation.sum(lambda p: emit({"r_name": p.look(names, p.n_regionkey).r_name}, {"nations": 1}))
    entries = Result(counts).to_dict()
    return Result.from_dict(spark, {k: (*v, k == ("AFRICA",)) for k, v in entries.items()}, {"r_name": str}, {"nations": int, "first_": bool}).coll


@query("select r_regionkey::bigint as k, case r_regionkey when 2 then 'changed' else r_name end as name from region union all select 9, 'new'")
def s10_get_set(t, spark):
    """Point lookup, and entries replaced and added."""
    r = Result(t.region.sum(lambda p: emit({"k": p.r_regionkey.cast("long")}, {"name": p.r_name}, unique=True)))
    if r.get(2) is None or r.get(77) is not None:
        raise ValueError("regions 0 to 4 are expected")
    return r.set(spark, (2,), ("changed",)).set(spark, (9,), ("new",)).coll


@query("select (select count(*) from region) as n, (select count(*) from nation) as m")
def s11_size(t, spark):
    return spark.createDataFrame([(Result(t.region).size(), Result(t.nation).size())], "n long, m long")


@query("select * from (values (1, 'a'), (2, 'b')) v(k, name)")
def s5_rows_binding(t, spark):
    """A collection of the caller's rows; repeated ones count once."""
    return Coll(from_rows(spark, [(1, "a"), (2, "b"), (1, "a")], {"k": int, "name": str}, distinct=True).df.select(F.col("k").cast("int").alias("k"), "name"))


# Summation by the shape of its body


@query("select cast(sum(l_quantity) as double) as value from lineitem where l_discount > 0.05")
def o1_scalar_sum(t, spark):
    return t.lineitem.sum(lambda p: scalar(p.l_quantity, when=p.l_discount > 0.05))


@query("select cast(0 as double) as value")
def o1_empty_sum(t, spark):
    """The sum of nothing is zero."""
    return t.lineitem.sum(lambda p: scalar(fn.money(p.l_quantity), when=p.l_quantity < 0))


@query("select sum(l_quantity) as a, count(*) as n from lineitem where l_returnflag = 'R'")
def o2_record_sum(t, spark):
    return t.lineitem.sum(lambda p: rec(a=p.l_quantity, n=1, when=p.l_returnflag == "R"))


@query("select l_suppkey, sum(l_quantity) as value from lineitem where l_quantity > 10 group by 1")
def o3_group_sum(t, spark):
    return t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, p.l_quantity, when=p.l_quantity > 10))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as n from lineitem group by all")
def o4_record_by_record(t, spark):
    return t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag, "l_linestatus": p.l_linestatus}, {"quantity": p.l_quantity, "n": 1}))


@query("select o_orderkey, o_custkey from orders")
def o5_unique_index(t, spark):
    """A unique key needs no aggregation, and so no shuffle."""
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey}, {"o_custkey": p.o_custkey}, unique=True))


@query("select l_returnflag, sum(l_quantity) as quantity from lineitem group by 1")
def o6_final_projection(t, spark):
    sums = t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag}, {"quantity": p.l_quantity}))
    return sums.sum(lambda p: emit(p.concat(), unique=True))


@query("select distinct l_suppkey from lineitem")
def o7_distinct(t, spark):
    return t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}))


@query("select o_orderpriority, count(*) as value from orders group by 1")
def o8_count(t, spark):
    return t.orders.sum(lambda p: emit({"o_orderpriority": p.o_orderpriority}, 1))


@query("select l_suppkey, l_returnflag, count(*) as n from lineitem group by all")
def o9_nested_group(t, spark):
    """{supplier: {flag: count}} in long form."""
    return t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, nested({"l_returnflag": p.l_returnflag}, {"n": 1})))


@query("select l_suppkey, count(distinct l_partkey) as parts from lineitem group by 1")
def o10_count_distinct(t, spark):
    sets = t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, nested({"l_partkey": p.l_partkey})))
    return sets.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, {"parts": 1}))


@query("select l_orderkey, count(distinct l_suppkey) as suppliers, count(l_suppkey) as lines from lineitem group by 1")
def o11_vectors(t, spark):
    """Items by key, as a set and as a bag."""
    items = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"s": vector(p.l_suppkey), "b": vector(p.l_suppkey, bag=True)}))
    return items.finish(lambda p: {"l_orderkey": p.l_orderkey, "suppliers": fn.dict_size(p.s), "lines": fn.dict_size(p.b)})


@query("with v as (select l_suppkey, sum(l_quantity) as quantity from lineitem group by 1) select * from v where quantity > 0.01 * (select sum(quantity) from v)")
def o12_total_and_groups(t, spark):
    total, per = t.lineitem.sum(lambda p: both(p.l_quantity, emit({"l_suppkey": p.l_suppkey}, {"quantity": p.l_quantity})))
    return per.sum(lambda p: emit(p.concat(), when=p.quantity > 0.01 * total.scalar(), unique=True))


@query("select l_returnflag, count(*) as n, sum(case when o_orderstatus = 'F' then l_quantity else 0 end) as done from lineitem join orders on o_orderkey = l_orderkey group by 1")
def o13_nested_loop(t, spark):
    """Goes through each order's nested map of flags."""
    lines = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, nested({"l_returnflag": p.l_returnflag}, {"n": 1, "quantity": p.l_quantity})))
    status = t.orders.join_build("o_orderkey", out=["o_orderstatus"])

    def body(p):
        done = p.look(status, p.l_orderkey).o_orderstatus == "F"
        return p.inner.sum(lambda q: emit({"l_returnflag": q.l_returnflag}, {"n": q.n, "done": F.when(done, q.quantity).otherwise(0.0)}))

    return lines.nest("l_returnflag").sum(body)


@query("select kinds, count(*) as orders, sum(n)::bigint as lines from (select l_orderkey, count(distinct l_returnflag) as kinds, count(*) as n from lineitem group by 1) group by 1")
def o13_inner_total(t, spark):
    """A body that adds up each order's nested map to numbers, by which it then groups."""
    lines = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, nested({"l_returnflag": p.l_returnflag}, {"n": 1})))

    def body(p):
        inner = p.inner.sum(lambda q: rec(kinds=1, n=q.n))
        return emit({"kinds": inner.kinds}, {"orders": 1, "lines": inner.n})

    return lines.nest("l_returnflag").sum(body)


@query("select l_orderkey, cast(sum(l_linenumber) as bigint) as numbers from lineitem group by 1")
def o14_vector_fold(t, spark):
    items = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"v": vector(p.l_linenumber.cast("long"), bag=True)}))
    return items.finish(lambda p: {"l_orderkey": p.l_orderkey, "numbers": semiring.fold(p.v, F.lit(0).cast("long"))})


@query("select l_orderkey, coalesce(sum(l_linenumber * l_linenumber) filter (where l_linenumber > 1), 0)::bigint as squares, bool_or(l_linenumber > 6) as long_ from lineitem group by 1")
def o14_vector_sum(t, spark):
    """The sum over a vector of what a body makes of each item that fulfils a condition."""
    items = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"v": vector(p.l_linenumber.cast("long"), bag=True)}))
    return items.finish(lambda p: {"l_orderkey": p.l_orderkey, "squares": semiring.vector_sum(p.v, lambda x: x * x, lambda x: x > 1, "long"), "long_": semiring.vector_sum(p.v, lambda x: x > 6, kind="boolean")})


@query("select l_suppkey, max(n) as most from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by all) group by 1")
def o15_inner_map(t, spark):
    inner = t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, nested({"l_returnflag": p.l_returnflag}, {"n": 1})))
    return semiring.highest(inner, ["l_suppkey"], "n").finish(lambda p: {"l_suppkey": p.l_suppkey, "most": p.n})


@query("select n, count(*) as orders from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def o16_chained_sums(t, spark):
    return t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"n": 1})).sum(lambda p: emit({"n": p.n}, {"orders": 1}))


# Expressions


@query("""select o_orderkey, case when o_totalprice > 1000 and not o_orderstatus = 'F' then 1.5 else 0.0 end as flagged, -o_custkey as negative,
  o_totalprice / 4.0 as quarter, o_custkey // 7 as whole, cast(o_custkey as double) as promoted, cast(o_custkey as varchar) as said
from orders where (o_orderstatus = 'O' or o_orderstatus = 'F') and o_custkey <> 3 and o_totalprice >= 1000 and o_totalprice <= 400000""")
def e1_expressions(t, spark):
    """Filters, conditionals, comparisons, logic, arithmetic, promotion."""
    return t.orders.sum(lambda p: emit({
        "o_orderkey": p.o_orderkey, "flagged": F.when((p.o_totalprice > 1000) & ~(p.o_orderstatus == "F"), 1.5).otherwise(0.0), "negative": -p.o_custkey,
        "quarter": p.o_totalprice / 4.0, "whole": fn.int_divide(p.o_custkey, F.lit(7)), "promoted": fn.promote(p.o_custkey), "said": fn.to_string(p.o_custkey),
    }, when=((p.o_orderstatus == "O") | (p.o_orderstatus == "F")) & (p.o_custkey != 3) & (p.o_totalprice >= 1000) & (p.o_totalprice <= 400000), unique=True))


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def e6_record_concat(t, spark):
    index = t.customer.sum(lambda p: emit({"c_custkey": p.c_custkey}, {"c_name": p.c_name, "c_nationkey": p.c_nationkey, "c_acctbal": p.c_acctbal}, unique=True))
    return index.sum(lambda p: emit(p[0].concat(p[1]), unique=True))


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as hit from orders")
def e19_membership_value(t, spark):
    """Membership inside a value; the index repeats keys."""
    index = t.lineitem.join_build("l_orderkey", lambda p: p.l_returnflag == "R")
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey, "hit": p.look(index, p.o_orderkey).flag()}, unique=True))


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as hit, not exists (select 1 from lineitem where l_orderkey = o_orderkey) as none_ from orders")
def e19_found_value(t, spark):
    """Guards themselves as values."""
    flagged, any_ = t.lineitem.join_build("l_orderkey", lambda p: p.l_returnflag == "R"), t.lineitem.join_build("l_orderkey")
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey, "hit": p.look(flagged, p.o_orderkey).found, "none_": p.look(any_, p.o_orderkey).missing}, unique=True))


@query("select o_orderkey, o_custkey % 7 as rest, cast(power(o_custkey, 2) as double) as square from orders")
def e12_modulo_power(t, spark):
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey, "rest": p.o_custkey % 7, "square": p.o_custkey**2}, unique=True))


@query("select l_returnflag, sum(l_quantity) as q from lineitem group by 1")
def e17_empty_map(t, spark):
    """The empty map is neutral in addition."""
    sums = t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag}, {"q": p.l_quantity}))
    return semiring.add(sums, semiring.empty(spark, "l_returnflag string, q double", ["q"]))


@query("select l_suppkey, sum(l_quantity) as q from lineitem group by 1")
def f10_dense(t, spark):
    """Hints of dense and unique keys change nothing in the result."""
    return t.lineitem.sum(lambda p: emit({"l_suppkey": fn.dense(1000, fn.unique(p.l_suppkey))}, {"q": p.l_quantity}))


# Joins


@query("select distinct o_orderkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey")
def j1_repeated_keys(t, spark):
    """A probe of repeated keys gives each of their values, and doesn't claim that the result's keys are unique."""
    index = t.lineitem.join_build("l_orderkey", out=["l_suppkey"])
    found = t.orders.join_probe(index, "o_orderkey", None, lambda v, p: emit({"o_orderkey": p.o_orderkey, "l_suppkey": v.l_suppkey}, unique=True), dealt=True)
    return relalg.dom(found)


@query("select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey where s_acctbal > 0")
def j1_build_probe(t, spark):
    nation = t.nation.join_build("n_nationkey", out=["n_name"], checked=True)
    return t.supplier.join_probe(nation, "s_nationkey", lambda p: p.s_acctbal > 0, lambda v, p: emit({"s_suppkey": p.s_suppkey}, {"n_name": v.n_name}, unique=True))


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def j4_semi(t, spark):
    index = t.lineitem.join_build("l_orderkey", lambda p: p.l_returnflag == "R")
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey}, when=p.look(index, p.o_orderkey).found, unique=True))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def j5_anti(t, spark):
    index = t.lineitem.join_build("l_orderkey")
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey}, when=p.look(index, p.o_orderkey).missing, unique=True))


@query("select o_orderkey, count(l_orderkey) as lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def j6_outer_default(t, spark):
    lines = t.lineitem.sum(lambda p: emit({"l_orderkey": p.l_orderkey}, {"lines": 1}))
    return t.orders.sum(lambda p: emit({"o_orderkey": p.o_orderkey}, {"lines": p.look(lines, p.o_orderkey).get("lines", 0)}, unique=True))


@query("select l_orderkey, l_linenumber from lineitem where exists (select 1 from supplier where s_suppkey = l_suppkey and s_nationkey = l_linenumber)")
def j7_composite_key(t, spark):
    """Keys match by position, whatever their names."""
    index = t.supplier.sum(lambda p: emit({"s_suppkey": p.s_suppkey, "s_nationkey": p.s_nationkey}, unique=True))
    return Coll(t.lineitem.where(lambda p: p.look(index, p.l_suppkey, p.l_linenumber).found).df.select("l_orderkey", "l_linenumber"))


@query("select r_name, sum(o_totalprice::decimal(12,2))::double as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1")
def j8_star(t, spark):
    """Several lookups in one body, each by what the one before has found."""
    cust, nation, region = t.customer.join_build("c_custkey", out=["c_nationkey"]), t.nation.join_build("n_nationkey", out=["n_regionkey"]), t.region.join_build("r_regionkey", out=["r_name"])

    def body(p):
        r = p.look(region, p.look(nation, p.look(cust, p.o_custkey).c_nationkey).n_regionkey)
        return emit({"r_name": r.r_name}, {"total": fn.money(p.o_totalprice)})

    return t.orders.sum(body)


@query("select sum(l_quantity) as value from lineitem join part on p_partkey = l_partkey where l_quantity > p_size")
def j9_residual(t, spark):
    parts = t.part.join_build("p_partkey", out=["p_size"])
    return t.lineitem.join_probe(parts, "l_partkey", None, lambda v, p: scalar(p.l_quantity, when=p.l_quantity > v.p_size))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem join (select l_partkey, sum(l_quantity) / count(*) as a from lineitem group by 1) using (l_partkey) where l_quantity > 1.9 * a")
def j10_self_aggregate(t, spark):
    sums = t.lineitem.sum(lambda p: emit({"l_partkey": p.l_partkey}, {"q": p.l_quantity, "n": 1}))
    rows = t.lineitem.where(lambda p: p.look(sums, p.l_partkey).found & (p.l_quantity > 1.9 * (p.look(sums, p.l_partkey).q / p.look(sums, p.l_partkey).n)))
    return rows.df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("select c_custkey from customer where c_acctbal > (select sum(c_acctbal::decimal(12,2))::double / count(*) from customer)")
def j11_scalar_broadcast(t, spark):
    sums = t.customer.sum(lambda p: rec(b=fn.money(p.c_acctbal), n=1)).finish(lambda p: {"average": p.b.cast("double") / p.n})
    return t.customer.sum(lambda p: emit({"c_custkey": p.c_custkey}, when=p.c_acctbal > sums.scalar("average"), unique=True))


@query("select distinct n.n_nationkey as n_n_nationkey, n.n_name as n_n_name, n.n_regionkey as n_n_regionkey, r.r_regionkey as r_r_regionkey, r.r_name as r_r_name from nation n join region r on n_regionkey = r_regionkey")
def j13_hash_equal_join(t, spark):
    return relalg.hash_equal_join(t.nation, t.region, "n", "r", "n_regionkey", "r_regionkey")


@query("select n.n_name as a_n_name, r.r_name as b_r_name from nation n, region r")
def j14_product(t, spark):
    return relalg.product(Coll(t.nation.df.select("n_name")), Coll(t.region.df.select("r_name")), "a", "b")


@query("select a.n_nationkey as a_n_nationkey, b.r_regionkey as b_r_regionkey from nation a, region b where a.n_nationkey < b.r_regionkey")
def j15_theta_join(t, spark):
    return relalg.theta_join(lambda f: f.a_n_nationkey < f.b_r_regionkey, Coll(t.nation.df.select("n_nationkey")), Coll(t.region.df.select("r_regionkey")), "a", "b")


# Aggregation


@query("""select l_returnflag, sum(l_quantity) as total, count(*) as n, sum(l_quantity) / count(*) as average, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as f,
  (sum(case when l_linestatus = 'F' then l_quantity else 0 end) / sum(l_quantity)) as part, count(distinct l_suppkey) as suppliers, bool_or(l_quantity > 49) as large
from lineitem group by 1 having count(*) > 10""")
def a1_aggregates(t, spark):
    """Sums, counts, averages, conditional sums, their ratio, distinct counts, "or", and a condition on groups."""
    sums = t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag}, {
        "total": p.l_quantity, "n": 1, "f": F.when(p.l_linestatus == "F", 1).otherwise(0), "q": F.when(p.l_linestatus == "F", p.l_quantity).otherwise(0.0), "large": p.l_quantity > 49, "s": vector(p.l_suppkey)}))
    return sums.sum(lambda p: emit({
        "l_returnflag": p.l_returnflag, "total": p.total, "n": p.n, "average": p.total / p.n, "f": p.f, "part": p.q / p.total, "suppliers": fn.dict_size(p.s), "large": p.large},
        when=p.n > 10, unique=True))


@query("select l_suppkey, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1")
def a11_min_max(t, spark):
    """Addition of the tropical semirings."""
    low, high = (f(t.lineitem, ["l_suppkey"], "l_quantity") for f in (semiring.lowest, semiring.highest))
    return low.sum(lambda p: emit({"l_suppkey": p.l_suppkey, "least": p.l_quantity, "most": p.look(high, p.l_suppkey).l_quantity}, unique=True))


# Sets and algebra


def _pairs(t, low: int, high: int) -> Coll:
    rows = t.lineitem.where(lambda p: (p.l_quantity >= low) & (p.l_quantity <= high))
    return Coll(rows.df.select("l_partkey", "l_returnflag").distinct(), unique=True)


_PAIRS = "select distinct l_partkey, l_returnflag from lineitem where l_quantity between {} and {}"


@query("select distinct l_partkey, l_returnflag from lineitem where l_partkey > 5")
def u1_selection(t, spark):
    return relalg.selection(lambda r: r.l_partkey > 5, _pairs(t, 0, 50))


@query("select distinct l_suppkey + 1 as next from lineitem")
def u2_projection(t, spark):
    return relalg.projection(lambda r: {"next": r.l_suppkey + 1}, t.lineitem)


@query(f"{_PAIRS.format(0, 30)} union {_PAIRS.format(20, 50)}")
def u3_union(t, spark):
    return relalg.union(_pairs(t, 0, 30), _pairs(t, 20, 50))


@query("select l_returnflag, count(*) as value from (select l_returnflag from lineitem union all select l_returnflag from lineitem where l_quantity < 5) group by 1")
def u3_bag_union(t, spark):
    few = t.lineitem.where(lambda p: p.l_quantity < 5)
    return relalg.bag_union(*(semiring.multiplicities(c.df.select("l_returnflag")) for c in (t.lineitem, few)))


@query(f"{_PAIRS.format(0, 30)} intersect {_PAIRS.format(20, 50)}")
def u4_intersection(t, spark):
    return relalg.intersection(_pairs(t, 0, 30), _pairs(t, 20, 50))


@query(f"{_PAIRS.format(0, 30)} except {_PAIRS.format(20, 50)}")
def u5_difference(t, spark):
    return relalg.difference(_pairs(t, 0, 30), _pairs(t, 20, 50))


@query("select distinct l_suppkey from lineitem")
def u6_dom(t, spark):
    return relalg.dom(t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, 1)))


def _flags(t, low: float) -> Coll:
    return t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag, "l_linestatus": p.l_linestatus}, {"q": p.l_quantity}, when=p.l_discount >= low))


@query("select l_returnflag, l_linestatus, sum(l_quantity) + coalesce(sum(l_quantity) filter (where l_discount >= 0.05), 0) as q from lineitem group by all")
def u7_map_addition(t, spark):
    return semiring.add(_flags(t, 0.0), _flags(t, 0.05))


@query("select l_returnflag, l_linestatus, sum(l_quantity) * 2.0 as q from lineitem group by all")
def u8_scaling(t, spark):
    return semiring.scale(2.0, _flags(t, 0.0))


@query("select a.l_returnflag, b.r_name, a.q * b.n as q from (select l_returnflag, sum(l_quantity) as q from lineitem group by 1) a, (select r_name, count(*) as n from region group by 1) b")
def u9_tensor(t, spark):
    left = t.lineitem.sum(lambda p: emit({"l_returnflag": p.l_returnflag}, {"q": p.l_quantity}))
    return semiring.tensor(left, t.region.sum(lambda p: emit({"r_name": p.r_name}, {"n": 1})))


@query("select o_orderkey, (o_totalprice + o_custkey) * 2.0 as a, (o_custkey + o_custkey) * 2.0 as b from orders")
def u10_record_algebra(t, spark):
    def body(p):
        one, two = {"a": p.o_totalprice, "b": p.o_custkey.cast("double")}, {"a": p.o_custkey, "b": p.o_custkey}
        return emit({"o_orderkey": p.o_orderkey}, semiring.scale_record(semiring.add_records(one, two), 2.0), unique=True)

    return t.orders.sum(body)


@query("select n_nationkey as x_k, n_name as y_name from nation")
def u11_prefixed_concat(t, spark):
    return t.nation.sum(lambda p: emit(relalg.concat({"k": p.n_nationkey}, {"name": p.n_name}, "x", "y"), unique=True))


@query("select cast(0 as bigint) as i, cast(0 as double) as f, false as b, '' as s")
def u12_zero(t, spark):
    kinds = {"i": "long", "f": "double", "b": "boolean", "s": "string"}
    return spark.range(1).select(*(semiring.zero(k).alias(c) for c, k in kinds.items()))


@query("select date '1970-01-01' as d, timestamp '1970-01-01' as t, cast(0 as integer) as i, cast(0 as double) as m, '' as v, 0 as n")
def u12_zero_all(t, spark):
    """Zeros of dates, times, small and exact numbers, text of bounded length, vectors (their size)."""
    kinds = {"d": "date", "t": "timestamp_ntz", "i": "int", "m": "decimal(12,2)", "v": "string"}
    columns = [semiring.zero(k).alias(c) for c, k in kinds.items()]
    return spark.range(1).select(*columns, F.size(semiring.zero("array<date>")).alias("n")).withColumn("m", F.col("m").cast("double"))


# Scalar functions


@query("""select c_custkey, starts_with(c_name, 'Customer#0') as starts, ends_with(c_name, '1') as ends_, strpos(c_name, '#') - 1 as at, strpos(c_name, 'zz') - 1 as nowhere,
  substr(c_name, 2, 3) as part, contains(c_name, '00') as has, c_name = 'x' as same from customer""")
def f2_strings(t, spark):
    return t.customer.sum(lambda p: emit({
        "c_custkey": p.c_custkey, "starts": fn.starts_with(p.c_name, "Customer#0"), "ends_": fn.ends_with(p.c_name, "1"), "at": fn.first_index(p.c_name, "#"), "nowhere": fn.first_index(p.c_name, "zz"),
        "part": fn.substr(p.c_name, 1, 3), "has": fn.contains(p.c_name, "00"), "same": p.c_name == "x"}, unique=True))


@query("select cast(year(o_orderdate) as bigint) as y, count(*) as value from orders group by 1")
def f1_year(t, spark):
    return t.orders.sum(lambda p: emit({"y": fn.extract_year(p.o_orderdate)}, 1))


@query("select l_suppkey, count(distinct l_returnflag) as flags from lineitem group by 1")
def f7_dict_size(t, spark):
    """Size of a map built at the output's edge."""
    inner = t.lineitem.sum(lambda p: emit({"l_suppkey": p.l_suppkey}, nested({"l_returnflag": p.l_returnflag}, {"n": 1})))
    return semiring.to_map(inner, ["l_returnflag"]).select("l_suppkey", fn.dict_size(F.col("entries")).alias("flags"))


@query(f"select o_custkey, cast(sum({_PRICE} * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue from lineitem join orders on o_orderkey = l_orderkey group by 1 order by revenue desc, o_custkey limit 10")
def x1_top(t, spark):
    """Order and limit are Spark's own."""
    orders = t.orders.join_build("o_orderkey", out=["o_custkey"])
    sums = t.lineitem.join_probe(orders, "l_orderkey", None, lambda v, p: emit({"o_custkey": v.o_custkey}, {"revenue": revenue(p)}))
    return sums.result().orderBy(F.desc("revenue"), "o_custkey").limit(10)
