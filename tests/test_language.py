"""Corners of the language on hand-made rows, plans, and laws of the algebra."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringfold.functions import scalar as fn
from ringfold.operators import relalg, semiring
from ringfold.plans import coll, inventory
from ringfold.plans.coll import Coll, both, emit, rec, scalar, vector
from ringfold.plans.declared import Session, declared
from ringfold.sources.bench import benchmark
from ringfold.sources.text import Result, date, from_rows, read_csv, string
from ringfold.streaming.fold import sum_stream, to_memory

KV = {"k": str, "v": int}


def entries(spark, rows):
    return Coll(from_rows(spark, rows, KV).df, ["k"], ["v"], unique=True)


def plan(coll):
    return coll.df._jdf.queryExecution().executedPlan().toString()


def values(coll):
    return sorted(tuple(r) for r in coll.result().collect())


def test_sum_of_nothing(spark):
    empty = from_rows(spark, [], KV)
    assert empty.sum(lambda p: scalar(p.v)).df.first()[0] == 0
    assert empty.sum(lambda p: rec(a=p.v, b=p.v > 1)).df.first().asDict() == {"a": 0, "b": False}
    assert values(empty.sum(lambda p: emit({"k": p.k}, p.v))) == []


def test_additive_merge_keeps_zeros(spark):
    a, b = entries(spark, [("a", 1)]), entries(spark, [("a", 2), ("b", 3)])
    assert values(semiring.add(a, b)) == [("a", 3), ("b", 3)]
    assert values(semiring.add(a, entries(spark, [("a", -1)]))) == [("a", 0)]


def test_bool_addition_is_or(spark):
    rows = from_rows(spark, [("a", 1), ("a", 5), ("b", 1)], KV)
    assert values(rows.sum(lambda p: emit({"k": p.k}, {"x": p.v > 2}))) == [("a", True), ("b", False)]


def test_strings(spark):
    df = spark.createDataFrame([("abab", "ab"), ("b", "ab"), ("abcdef", "cd"), ("abc", "z")], "s string, k string")
    got = df.select(fn.ends_with(F.col("s"), F.col("k")), fn.first_index(F.col("s"), F.col("k")), fn.substr(F.col("s"), 1, 3)).collect()
    assert [tuple(r) for r in got] == [(True, 0, "bab"), (False, -1, ""), (False, 2, "bcd"), (False, -1, "bc")]


def test_repeated_build_keys(spark):
    right = from_rows(spark, [("a", 1), ("a", 2)], KV)
    left = from_rows(spark, [("a", 7), ("b", 8)], KV)
    checked = right.join_build("k", out=["v"], checked=True)
    with pytest.raises(Exception, match="repeat"):
        left.join_probe(checked, "k", None, lambda v, p: emit({"k": p.k}, {"v": v.v}, unique=True)).df.collect()
    exists = right.join_build("k")
    assert values(left.join_probe(exists, "k", None, lambda v, p: emit({"k": p.k}, {"x": p.v}, unique=True))) == [("a", 7)]
    assert values(left.sum(lambda p: emit({"k": p.k}, {"hit": p.look(exists, p.k).flag()}, unique=True))) == [("a", True), ("b", False)]


def test_missing_keys(spark):
    index = from_rows(spark, [("a", 1)], KV).join_build("k", out=["v"])
    left = from_rows(spark, [("a", 7), ("b", 8)], KV)
    assert values(left.sum(lambda p: emit({"k": p.k, "v": p.look(index, p.k).v}, unique=True))) == [("a", 1)]
    assert values(left.sum(lambda p: emit({"k": p.k, "v": p.look(index, p.k).get("v", 0)}, unique=True))) == [("a", 1), ("b", 0)]
    with pytest.raises(Exception, match="missing key"):
        left.sum(lambda p: emit({"k": p.k, "v": p.look(index, p.k).v}, unique=True), strict=True).df.collect()


def test_default_is_for_missing_keys_not_null_values(spark):
    index = Coll(spark.createDataFrame([("a", None)], "k string, v long"), ["k"], ["v"], unique=True)
    left = from_rows(spark, [("a", 7), ("b", 8)], KV)
    assert values(left.sum(lambda p: emit({"k": p.k, "v": p.look(index, p.k).get("v", 0)}, unique=True))) == [("a", None), ("b", 0)]


def test_vectors(spark):
    got = from_rows(spark, [("a", 1), ("a", 1), ("a", 2)], KV).sum(lambda p: emit({"k": p.k}, {"s": vector(p.v), "b": vector(p.v, bag=True)}))
    assert tuple(got.df.select(F.size("s"), F.size("b")).first()) == (2, 3)


def test_fields_that_clash(spark):
    with pytest.raises(ValueError):
        entries(spark, []).sum(lambda p: emit(p[0].concat(p[0]), unique=True))


def test_plans(spark):
    big = Coll(spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v")))
    assert "Exchange" not in plan(big.sum(lambda p: emit({"k": p.k}, {"v": p.v}, unique=True)))
    index = Coll(spark.range(5).select(F.col("id").alias("i"))).join_build("i")
    assert "LeftSemi" in plan(big.sum(lambda p: emit({"k": p.k}, when=p.look(index, p.k).found, unique=True)))
    assert "LeftAnti" in plan(big.sum(lambda p: emit({"k": p.k}, when=p.look(index, p.k).missing, unique=True)))
    twice = big.sum(lambda p: emit({"k": p.k, "a": p.look(index, p.k).flag(), "b": p.look(index, p.k).flag()}, unique=True))
    assert twice.df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_text(spark, tmp_path):
    (tmp_path / "t.tbl").write_text('1|1996-03-04|2.5|abcdef|\n2|1997-01-01|-1|"x|y"|\n')
    got = read_csv(spark, str(tmp_path / "t.tbl"), {"k": int, "d": date, "x": float, "s": string(4)})
    assert [(r.k, str(r.d), r.x, r.s) for r in got.df.orderBy("k").collect()] == [(1, "1996-03-04", 2.5, "abcd"), (2, "1997-01-01", -1.0, "x|y")]
    assert values(read_csv(spark, str(tmp_path / "t.tbl"), {"k": int, "d": date}, include=["k"], distinct=True)) == [(1,), (2,)]


def test_result_handle(spark, capsys):
    r = Result.from_dict(spark, {("a",): (1.5,), ("b",): (2.0,)}, {"k": str}, {"x": float})
    assert r.size() == 2 and r.get("a") == (1.5,) and r.get("z") is None and r.size() == 2
    assert r.to_dict() == {("a",): (1.5,), ("b",): (2.0,)}
    assert r.set(spark, ("a",), (9.0,)).to_dict() == {("a",): (9.0,), ("b",): (2.0,)}
    r.print()
    assert "1.50" in capsys.readouterr().out


def test_benchmark(spark):
    mean, deviation = benchmark("count", 2, lambda: spark.range(10), [], verbose=False)
    assert mean > 0 and deviation >= 0


def test_streaming_sum(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "in"))
    q = to_memory(sum_stream(stream, lambda p: emit({"k": p.k}, {"v": p.v}, when=p.v > 0)), "sums")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == [("a", 4), ("b", 2)]


maps = st.dictionaries(st.sampled_from("abcd"), st.integers(-5, 5), max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(maps, maps, maps, st.integers(-3, 3))
def test_laws(spark, x, y, z, s):
    a, b, c = (entries(spark, list(m.items())) for m in (x, y, z))
    assert values(semiring.add(a, b)) == values(semiring.add(b, a))
    assert values(semiring.add(semiring.add(a, b), c)) == values(semiring.add(a, semiring.add(b, c)))
    assert values(semiring.add(a, semiring.empty(spark, "k string, v long", ["v"]))) == values(a)
    assert values(semiring.scale(s, semiring.add(a, b))) == values(semiring.add(semiring.scale(s, a), semiring.scale(s, b)))


def test_guards_as_values(spark):
    left, index = from_rows(spark, [("a", 7), ("b", 8)], KV), from_rows(spark, [("a", 1), ("a", 2)], KV).join_build("k")
    got = left.sum(lambda p: emit({"k": p.k, "hit": p.look(index, p.k).found & (p.v > 1), "none": p.look(index, p.k).missing}, unique=True))
    assert values(got) == [("a", True, False), ("b", False, True)]
    assert tuple(left.sum(lambda p: rec(any_=p.look(index, p.k).found, both=p.look(index, p.k).found & (p.v > 7))).df.first()) == (True, False)


def test_repeated_keys_are_not_claimed_unique(spark):
    index = from_rows(spark, [("a", 1), ("a", 2)], KV).join_build("k", out=["v"])
    left = from_rows(spark, [("a", 7)], KV)
    found = left.join_probe(index, "k", None, lambda v, p: emit({"k": p.k}, {"v": v.v}, unique=True))
    assert values(found) == [("a", 1), ("a", 2)] and not found.unique
    assert values(relalg.dom(found)) == [("a",)]
    assert left.sum(lambda p: emit({"k": p.k}, unique=True)).unique


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_tasks_of_repeated_keys_follow_the_input(spark, tmp_path, monkeypatch, request, broadcast):
    """j1_repeated_keys over four times the input: four times the tasks, each with no more rows, and the rows of SQL."""
    monkeypatch.setattr(coll, "TASK_BYTES", 4000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    tasks, most = [], []
    for n in (5_000, 20_000):
        # Of every 10 orders one occurs twice and one has no lines; lines repeat, and there are null keys on both sides.
        orders = spark.range(n).union(spark.range(0, n, 10)).select(F.col("id").alias("o_orderkey")).union(spark.sql("select cast(null as bigint)"))
        lines = spark.range(4 * n).select((F.col("id") % n).alias("l_orderkey"), (F.col("id") % 3).alias("l_suppkey")).where("l_orderkey % 10 <> 1")
        lines = lines.union(lines.where("l_orderkey % 7 = 0")).union(spark.sql("select cast(null as bigint), 1L union all select -1L, 1L"))
        orders.write.parquet(str(tmp_path / f"{n}/orders.parquet"))
        lines.write.parquet(str(tmp_path / f"{n}/lineitem.parquet"))
        got = [(r.o_orderkey, r.l_suppkey, r.at) for r in inventory.QUERIES["j1_repeated_keys"](spark, str(tmp_path / str(n))).withColumn("at", F.spark_partition_id()).collect()]
        want = {(i % n, i % 3) for i in range(4 * n) if i % n % 10 != 1}
        assert sorted(r[:2] for r in got) == sorted(want)
        rows = Counter(r[2] for r in got)
        tasks, most = [*tasks, len(rows)], [*most, max(rows.values())]
    assert tasks[1] >= 3 * tasks[0] and most[1] <= 1.3 * most[0]


def test_dealt_probe(spark, monkeypatch):
    """The same entries as otherwise: by several keys, with a condition, keys of other types, and null keys left out."""
    right = spark.sql("select * from values ('a', 1, 10), ('a', 1, 11), ('b', 2, 12), (null, 3, 13) t(k, i, v)")
    left = Coll(spark.sql("select * from values ('a', 1L), ('a', 1L), ('b', 2L), ('c', 2L), (null, 3L) t(k, i)"))
    index = Coll(right).join_build(["k", "i"], out=["v"])
    for size in (1, 1 << 40):
        monkeypatch.setattr(coll, "TASK_BYTES", size)
        found = left.join_probe(index, ["k", "i"], lambda p: p.i < 9, lambda v, p: emit({"k": p.k, "v": v.v}, {"n": 1}), dealt=True)
        assert values(found) == [("a", 10, 2), ("a", 11, 2), ("b", 12, 1)]
        assert ("REPARTITION_BY_NUM" in plan(found)) == (size == 1)
    monkeypatch.setattr(coll, "TASK_BYTES", 8000)
    rows = spark.range(100_000)  # 8 bytes each
    assert coll._tasks(rows) == 100 and coll._tasks(rows, rows) == 200
    assert coll._tasks(rows.join(rows.select(F.col("id").alias("j")), F.col("id") < F.col("j"))) == 200
    assert coll._tasks(rows.limit(10)) == coll._tasks(spark.createDataFrame(rows.rdd)) == 0


def test_nested_sums(spark):
    rows = Coll(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 5)], "k string, i string, v long"), ["k", "i"], ["v"], unique=True)
    totals = rows.nest("i").sum(lambda p: emit({"k": p.k}, {"most": p.inner.sum(lambda q: scalar(q.v, when=q.v > 1))}, unique=True))
    assert values(totals) == [("a", 2), ("b", 5)]
    assert values(rows.nest("i").sum(lambda p: emit({"k": p.k}, p.inner.sum(lambda q: emit({"i": q.i}, {"v": q.v * 2}))))) == [("a", "x", 2), ("a", "y", 4), ("b", "x", 10)]
    with pytest.raises(ValueError):
        rows.nest("v")
    record = rows.sum(lambda p: both(p.v, emit({"k": p.k}, {"v": p.v})))
    assert record.total.df.first()[0] == 8 and values(record.groups) == [("a", 3), ("b", 5)]


def test_declared(spark, tmp_path):
    @declared(t={"k": str, "v": int})
    def sums(t):
        return t.sum(lambda p: emit({"k": p.k}, {"v": p.v}))

    t = from_rows(spark, [("a", 1), ("a", 2)], KV)
    assert values(sums(t)) == values(sums(t=t)) == [("a", 3)]
    for wrong in (3, Coll(t.df.select("k"))):
        with pytest.raises(TypeError):
            sums(wrong)
    with pytest.raises(TypeError):
        declared(other={"k": str})(lambda t: t)
    with pytest.raises(KeyError):
        declared(t={"k": "a type"})(lambda t: t)
    session = Session(spark, {"t": t})
    kept = session.run(sums, name="sums", path=str(tmp_path / "sums"))
    assert "FileScan parquet" in plan(kept) and values(session.run(sums, t="sums")) == [("a", 3)]
    with pytest.raises(KeyError):
        session.run(sums, t="nothing")


def test_vector_sum(spark):
    v = spark.createDataFrame([([1, 2, 3],), ([],)], "v array<long>")
    got = v.select(semiring.vector_sum(F.col("v"), lambda x: x * 2, lambda x: x > 1, "long"), semiring.vector_sum(F.col("v"), lambda x: x > 2, kind="boolean")).collect()
    assert [tuple(r) for r in got] == [(10, True), (0, False)]
