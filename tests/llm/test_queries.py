"""The registered queries on the smallest tables: columns and types of their contracts, SQL where there is some, and whole tables."""

import collections
import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ringfold.llm import lm, queries, sharding, toxicity
from test_operators import brute_groups, surface, texts, words
from test_oracle import SF, TABLES, rows

SCHEMAS = {
    "op1_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_sentencepiece": "doc_id bigint, n_ids bigint",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def source(con):
    return con.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, source, name):
    df = queries.QUERIES[name](spark, SF)
    have = dict(df.dtypes)
    for column in SCHEMAS[name].split(", "):
        c, kind = column.split()
        assert have.get(c) == kind, c
    got = df.collect()
    if name == "op1_chat_formatting":
        assert -7 in {r.conv_id for r in got} and all(r.round_trip for r in got)
    else:
        assert {r.doc_id for r in got} == {i for i, _ in source}
    if name in queries.ORACLE_SQL:
        found = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_op2_base(spark, source):
    c = collections.Counter()
    for i, t in source:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in queries.op2_lm_scoring(spark, SF).collect():
        w = [*words(dict(source)[r.doc_id]), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert len(queries.PRIORS) == 2 and lm.ORDER == 2


def test_op3_groups(spark, source):
    assert sorted(map(tuple, queries.op3_ngram_jaccard_join(spark, SF).collect()), key=repr) == brute_groups(source, 4, 85)


def test_op5_surface(spark, source):
    for r in queries.op5_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == surface(dict(source)[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_op7_cut(spark):
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.REJECT) for r in queries.op7_toxicity(spark, SF).collect())


@pytest.mark.parametrize("shards, virtual", [(5, 7), (3, 2), (24, 128)])
def test_ring(spark, shards, virtual):
    """Every row's shard and slot against keys put one by one on a ring."""
    rows_ = texts() + [(k % 40 + 2000, "same" if k % 3 else f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(df, shards, virtual_nodes=virtual).collect())
    points = sharding.ring_points(spark, shards, virtual)
    place = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("h")).collect()}
    keys = sorted((place[i], i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_)
    home = lambda at: next((k for k, (p, _) in enumerate(points) if at <= p), 0)
    by_arc = collections.defaultdict(list)
    for key in keys:
        by_arc[home(key[0])].append(key)
    # Keys beyond the last point belong to the first one, after those that lie before it on the ring's line.
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    filled, want, moved = [0] * shards, [], collections.defaultdict(list)

    def put(key, s):
        want.append((key[2] if key[1] else None, key[3], key[4], s, filled[s]))
        filled[s] += 1

    for arc, (_, s) in enumerate(points):
        for key in by_arc[arc]:
            (put(key, s) if filled[s] < room[s] else moved[arc].append(key))
    queue = collections.deque()
    for step in range(2 * len(points)):
        arc = step % len(points)
        s = points[arc][1]
        while queue and filled[s] < room[s]:
            put(queue.popleft(), s)
        if step < len(points):
            queue.extend(moved[arc])
    assert not queue and collections.Counter(want) == got


def test_growing_ring(spark):
    """One shard more moves little beyond its own share."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.shard(df, shards=n).collect()} for n in (24, 25))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)
