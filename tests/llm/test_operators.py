"""Each operator against a plain version of its contract, on texts with every awkward case."""

import collections
import hashlib
import itertools
import json
import math
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringfold.llm import chat, components, exact_dedup, jaccard, lm, packing, quality, queries, secrets, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    """Rows (id, text): nulls, empties, blanks, equal and nearly equal ones, clashing control strings, a long one."""
    base = " ".join(f"w{i % 37}x{i * i % 91}" for i in range(120))
    out = [None, "", "  \n\t ", "one", "two words", "Four words are here", "FOUR words are here", base, base.upper(), base + " end", "start " + base]
    out += [base.replace("w5x25", "zz", 1), "İ é ß 漢字 \U0001f600 \x85   \x1c odd", "a\n\na\nb\na", "x " * 300, "Token: abcdef123 AKIA" + "A" * 16 + " " + "0" * 24]
    out += ["secret: token : abcdefgh", "api-key=1 api_key = 'zyxwvu'", "kéy passwd=\"éa\" PASSWORD=abc.def", "<|endoftext|> it's we'll", " ".join(f"long{i}" for i in range(30_000))]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(100 + i, t) for i, t in rows[:9]] + [(3, "one"), (None, "two words")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts()]
    # Columns whose names clash with what operators use inside.
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in ("norm", "ratio", "kept", "flag", "digest", "place", "tie")}).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def lower(t):
    return (t or "").encode().lower()


def words(t):
    return lower(t).split()


# chat


def test_chat(spark):
    rows = [(1, 0, "user", "<s>[INST] a \\ <\\s> <<\\SYS>> <<<SYS>>>"), (1, 1, None, None), (1, 1, "assistant", "x[ROLE]<"), (1, 2, "[ROLE]a[/ROLE]<s>", "[\\INST]</s")]
    rows += [(2, None, "tool", "é</s></s>"), (2, 1, "assistant", "abé"), (2, 1, "assistant", "abé"), (None, 1, "", ""), (3, 1, "a[b", "<"), (3, 2, "<", "s>"), (4, 0, "system", "[/INST]" * 2000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, at string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv]["round_trip"]
        assert [tuple(p) for p in got[conv]["parsed"]] == [(r, x) for _, r, x in turns]
        assert got[conv]["loss"] == "".join(x for _, r, x in turns if r == "assistant")
    assert chat.format_chats(df.where("false")).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.text(st.sampled_from("<>[]/\\sISTNYROLE a"), max_size=14)), min_size=1, max_size=12))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chats(df).collect()
    assert row["round_trip"] and [tuple(p) for p in row["parsed"]] == turns


# language model


def test_lm(docs, none):
    got = collections.Counter()
    rows = texts()
    trained = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if trained(i):
            w = [*words(t), b"\n"]
            c.update(w)
            pairs.update(zip([b" ", *w], w, strict=False))
    n, v, k = sum(c.values()), len(c), lm.PRIOR
    want = collections.Counter()
    for i, t in rows:
        w = [*words(t), b"\n"]
        root = [(c[x] + 1) / (n + v + 1) for x in w]
        score = 0.0
        for h, x, p in zip([b" ", *w], w, root, strict=False):
            hist = c[b"\n"] if h == b" " else c[h]
            score += math.log10((pairs[h, x] + k * p) / (hist + k) if hist else p)
        want[i, not trained(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(map(math.log10, root)), 4), round(score, 4)] += 1
    for r in lm.score_texts(docs, block_words=200).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)] += 1
    assert got == want
    assert lm.score_texts(none).count() == 0


@pytest.mark.parametrize("order, priors", [(1, ()), (3, (5.0, 2.0)), (4, (3.0, 2.0, 0.5))])
def test_lm_orders(docs, order, priors):
    """Longer n-grams against the formula, without automaton; after each history the probabilities add up to one."""
    rows = texts()
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            w = (b" ", *words(t), b"\n")
            c.update(w[k : k + j] for j in range(1, order + 1) for k in range(1 if j == 1 else 0, len(w) - j + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    seen = lambda h: c[b"\n",] if h == (b" ",) else c[h]

    def p(h, x):
        if not h:
            return (c[x,] + 1) / (n + v + 1)
        return (c[(*h, x)] + priors[len(h) - 1] * p(h[1:], x)) / (seen(h) + priors[len(h) - 1])

    want = collections.Counter()
    for i, t in rows:
        w = (b" ", *words(t), b"\n")
        want[i, round(sum(math.log10(p(w[max(0, k - order + 1) : k], w[k])) for k in range(1, len(w))), 4)] += 1
    got = collections.Counter((r.doc_id, round(r.score, 4)) for r in lm.score_texts(docs, block_words=200, order=order, prior=priors).collect())
    assert got == want
    if order == 3:
        vocabulary = [g[0] for g in c if len(g) == 1]
        for h in ((), (b" ",), (b"one",), (b" ", b"two"), (b"long7", b"long8"), (b"never", b"seen")):
            assert sum(p(h, x) for x in vocabulary) + p(h, b"unseen") == pytest.approx(1)


def test_lm_automata_are_small(spark, monkeypatch):
    """However large a block is, an automaton holds some of its texts, and the scores stay the same."""
    largest, made = [], lm.Automaton.__init__

    def init(self, grams, *rest):
        largest.append(len(grams.within))
        made(self, grams, *rest)

    monkeypatch.setattr(lm.Automaton, "__init__", init)
    monkeypatch.setattr(lm, "exchange", lambda rows, asks, answer, *rest: answer_alone(asks, answer, rest[-1]))

    def answer_alone(asks, answer, totals):
        words = [b"w%d" % (i * i % 17) for i in range(600)]
        names = sorted(set(words))
        table = np.array([blocks.word_hash(w) for w in names], np.uint64)
        lens = [5, 0, 300, 1, 94, 200]
        block = blocks.Block(list(range(6)), np.ones(6, np.uint8), np.cumsum(lens), np.array([names.index(w) for w in words], np.int32), table)
        counts = [ask(block)[0][1] for ask in asks]
        totals += [(len(c), int(c.sum())) for c in counts]
        return [r for b in answer(block, counts) for r in b.to_pylist()]

    import numpy as np

    from ringfold.llm import blocks

    docs = spark.createDataFrame([], "doc_id long, text string")
    whole = lm.score_texts(docs, order=3, prior=(5.0, 2.0))
    assert len(whole) == 6 and largest == [606]
    monkeypatch.setattr(lm, "WALKED", 100)
    assert lm.score_texts(docs, order=3, prior=(5.0, 2.0)) == whole
    assert largest[1:] == [7, 301, 97, 201]


def test_lm_walk_calls_nothing(spark, monkeypatch):
    """A token costs no call: arcs are found by n-grams' numbers, not by lookups. Nor are a block's keys hashed to be sorted."""
    import cProfile

    import numpy as np

    from ringfold.llm import blocks

    called = {}

    def answer_alone(rows, asks, answer, *rest):
        rng = np.random.default_rng(7)
        words = (rng.random(20_000) ** 3 * 2_000).astype(np.int32)
        block = blocks.Block(list(range(40)), np.ones(40, np.uint8), np.arange(1, 41) * 500, words, rng.integers(1, 1 << 63, 2_000).astype(np.uint64))
        told = [ask(block)[0][1] // np.uint32(2) for ask in asks]  # n-grams found once are unknown, so that states fail
        rest[-1][:] = [(int((c > 0).sum()), int(c.sum())) for c in told]
        profile = cProfile.Profile()
        out = profile.runcall(lambda: list(answer(block, told)))
        assert [len(b) for b in out] == [40]
        called.update({str(e.code): e.callcount for e in profile.getstats()})

    monkeypatch.setattr(lm, "exchange", answer_alone)
    lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), order=3, prior=(500.0, 50.0))
    assert sum(called.values()) < 10_000, sorted(called.items(), key=lambda c: -c[1])[:3]
    assert not [c for c in called if "unique_hash" in c]


def test_totals_beyond_32_bits(spark):
    """Blocks get corpus totals in full, though each block's own counts fit 32 bits."""
    import numpy as np
    import pyarrow as pa

    from ringfold.llm import blocks, common

    rows = spark.createDataFrame([(i, "a b" if i else "a", 1) for i in range(3)], "doc_id long, text string, flag int").repartition(1)
    large = np.uint64(blocks.word_hash(b"a"))

    def ask(block):
        keys = np.unique(block.table)
        return [(keys, np.where(keys == large, 3_000_000_000, 1).astype(np.uint32))]

    def answer(block, told):
        keys = np.unique(block.table)
        yield pa.RecordBatch.from_arrays([pa.array([int(n) for n in told[0][keys == large]], pa.int64()), pa.array([int(told[0].min())], pa.int64())], names=["a", "least"])

    totals = []
    out = blocks.exchange(rows, ask, answer, "a long, least long", lambda df: common.kept(df, "counts"), 1, totals).collect()
    assert [r.a for r in out] == [9_000_000_000] * 3 and sorted(r.least for r in out) == [2, 2, 9_000_000_000]
    assert totals == [(2, 9_000_000_002)]


# near duplicates


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_answered_questions_leave_the_disk(spark):
    """Before the blocks meet their answers, what they have asked is gone, and so is it before the next kind is asked."""
    import numpy as np

    from ringfold.llm import blocks, common

    rows = spark.createDataFrame([(i, f"w{i % 7} v{i}", 1) for i in range(50)], "doc_id long, text string, flag int")
    common.discard(spark)
    before, left = shuffle_files(spark), []
    ask = lambda block: [(np.unique(block.table), np.ones(len(block.table), np.uint32))]

    def keep(df):
        left.append(shuffle_files(spark) - before)
        return common.kept(df, "counts")

    out = blocks.exchange(rows, [ask, ask], lambda block, told: iter(()), "doc_id long", keep, block_words=20)
    left.append(shuffle_files(spark) - before)
    assert left == [set()] * 4 and out.columns == ["doc_id"]  # at the blocks, each kind's answers, and the end


def test_texts_are_sent_in_small_batches(spark):
    """Blocks are made from few texts at a time, and the session's setting comes back."""
    import pyarrow as pa

    from ringfold.llm import blocks, common

    def sizes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def keep(df):
        seen.append(int(spark.conf.get(name)))
        return common.kept(df, "counts")

    rows = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, flag int")
    blocks.exchange(rows, lambda block: [], lambda block, told: iter(()), "doc_id long", keep)
    assert seen == [blocks.ROWS, int(before)] and spark.conf.get(name) == before
    with common.rows_at_once(spark, 10):
        sizes = spark.range(95).coalesce(1).mapInArrow(sizes_of, "n long").collect()
    assert sum(r.n for r in sizes) == 95 and max(r.n for r in sizes) <= 10


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


def near_copies():
    """Chains of near copies: each a few words from the next, ends far apart; small and large sets; a shared passage."""
    rows, n = [], 1000
    passage = " ".join(f"p{i}" for i in range(60))
    for size in (8, 12, 20, 60, 200):
        w = [f"s{size}_{i}" for i in range(size)]
        for step in range(14):
            rows.append((n, " ".join(w)))
            n += 1
            w[(step * 7) % size] = f"edit{step}"
    rows += [(n + i, passage + f" tail{i} more{i} again{i}") for i in range(12)] + [(n + 50 + i, f"lone{i} " + passage + " " + " ".join(f"q{i}_{j}" for j in range(90))) for i in range(12)]
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, none, k, percent):
    rows = texts() + near_copies()
    df = docs.select("doc_id", "text", "digest").union(spark.createDataFrame([(i, t, "x") for i, t in near_copies()], "doc_id long, text string, digest string"))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, shingle=k, percent=percent, block_words=700).collect()]
    assert sorted(got, key=repr) == brute_groups(rows, k, percent)
    assert jaccard.jaccard_join(none).count() == 0


@pytest.mark.parametrize("small", jaccard.BOUNDARIES)
def test_jaccard_boundaries(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "boundary", lambda reps: small)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_join(df, shingle=4, percent=85).collect()]
    assert sorted(got, key=repr) == brute_groups(rows, 4, 85)


@pytest.mark.parametrize("percent, small", [(10, 8), (34, 0), (50, 8), (50, 128), (100, 8)])
def test_jaccard_of_few_words(spark, monkeypatch, percent, small):
    """Sets that link by one common element, or by all of them, whatever the boundary."""
    monkeypatch.setattr(jaccard, "boundary", lambda reps: small)
    rows = [(1, "a"), (2, "a b"), (3, "a b c"), (4, "c d e f g h i j k l"), (5, "l"), (6, "m n"), (7, "n o"), (8, "p q r"), (9, "r s t"), (10, "Q r p"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_join(df, shingle=1, percent=percent).collect()]
    assert sorted(got, key=repr) == brute_groups(rows, 1, percent)


def test_jaccard_of_common_words(spark, monkeypatch):
    """Sets that share common elements but aren't similar make few pairs to verify."""
    import random

    rnd, verified = random.Random(7), []
    plain = jaccard._verified

    def counting(pairs, reps, percent):
        verified.append(pairs.count())
        return plain(pairs, reps, percent)

    monkeypatch.setattr(jaccard, "_verified", counting)
    rows = [(k, " ".join(f"c{rnd.randrange(60)}" for _ in range(30))) for k in range(400)] + [(1000, rows_ := " ".join(f"c{j}" for j in range(28))), (1001, rows_ + " c28")]
    got = [tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=85).collect()]
    assert sorted(got, key=repr) == brute_groups(rows, 1, 85)
    assert verified[1] < 500


def test_spread_join(spark, monkeypatch):
    """Hot keys are joined apart, with the same result."""
    from ringfold.llm import common

    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)] + [(None, 1000)], "key long, x long")
    right = spark.createDataFrame([(k, k * 10) for k in (0, 1, 95, 96)], "key long, y long")
    want = {how: sorted(map(repr, left.join(right, "key", how).collect())) for how in ("inner", "left")}
    for rows, keys in ((5, 100), (5, 1), (1000, 100)):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        for how, rows_ in want.items():
            assert sorted(map(repr, common.spread_join(left, right, "key", how).collect())) == rows_


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=30))
def test_components(spark, links):
    names = [(f"{a:02d}", f"{b:02d}") for a, b in links]
    up = {x: x for p in names for x in p}
    for _ in up:
        for a, b in names:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components.components(spark.createDataFrame(names, "a string, b string").repartition(3)).collect()))
    assert got == {x: r for x, r in up.items() if x != r}


# sharding


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=5, virtual_nodes=7).collect()
    rows = texts()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(none, shards=3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=12, max_size=12), st.permutations([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]))
def test_flows(counts, order):
    """Against keys placed one by one."""
    total = sum(counts)
    capacity = [total // 4 + (s < total % 4) for s in range(4)]
    got = sharding.flows([(i, s) for i, s in enumerate(order)], counts, capacity)
    home = collections.Counter()
    for arc, s in enumerate(order):
        home[s] += counts[arc]
    placed = collections.Counter()
    seen = set()
    for arc, first, end, s, slot in got:
        placed[s] += end - first
        seen |= {(arc, k) for k in range(first, end)}
    assert len(seen) == total == sum(placed.values()) and all(placed[s] == capacity[s] for s in range(4))
    # A shard that isn't over its capacity keeps all its own keys.
    for arc, s in enumerate(order):
        if home[s] <= capacity[s] and counts[arc]:
            assert (arc, 0, counts[arc], s) in {g[:4] for g in got}


def test_growing_moves_few(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.shard(df, shards=n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.45 * len(a)


# quality


def surface(t):
    t = t or ""
    w = WORDS.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, docs, none):
    trusted = spark.createDataFrame([(7,), (7,), (9,), (None,)], "doc_id long")
    got = quality.quality_rules(docs, trusted).collect()
    assert sorted([(r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == sorted((i or -1, *surface(t)) for i, t in texts())
    assert all(r.kept == (not r.base_failed and r.ratio >= quality.LEAST_RATIO) for r in got)
    assert quality.quality_rules(none, trusted).count() == 0
    assert {r.ratio for r in quality.quality_rules(docs, trusted.where("false")).collect()} == {0.0}


def test_quality_ratio(spark):
    rows = [(1, "a b a"), (2, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = {i: [(x,) for x in t.split()] + list(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    number = {}
    for g in {g for gs in grams.values() for g in gs}:
        number[g] = spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, g)), F.lit(50))).first()[0]
    raw = collections.Counter(number[g] for gs in grams.values() for g in gs)
    good = collections.Counter(number[g] for g in grams[1])
    ratio = lambda b: math.log((good[b] + 1) / (sum(good.values()) + 50)) - math.log((raw[b] + 1) / (sum(raw.values()) + 50))
    got = quality.quality_rules(df, spark.createDataFrame([(1,)], "doc_id long"), buckets=50).collect()
    for r in got:
        assert r.ratio == pytest.approx(sum(ratio(number[g]) for g in grams[r.doc_id]) / len(grams[r.doc_id]))


# toxicity


def test_toxicity(spark, docs, none):
    ordinary = [f"the house near river {i} was quiet and {i * 7 % 13} birds sang over mills" for i in range(240)]
    toxic = [t + " blorgface snarkweed" if i % 2 else "you blorgface " + t + " snarkweed" for i, t in enumerate(ordinary)]
    rows = [(i, t, 0) for i, t in enumerate(ordinary)] + [(1000 + i, t, 1) for i, t in enumerate(toxic)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, 0), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert all(got[i].predicted == y == (got[i].score >= 0.7) for i, y in held)
    odd = toxicity.score_toxicity(docs, labels).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(df, labels.where("false")).count() == len(rows)
    left = toxicity.drop_toxic(df.withColumn("_passage", F.lit("mine")), labels)
    assert left.columns == ["doc_id", "text", "_passage"] and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_long_texts(spark):
    """Clean texts aren't rejected for their length: neither by a mislabelled text's own words, however often it
    says them, nor as the strongest of more words are stronger by chance."""
    import random

    rnd = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    text = lambda n: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, text(rnd.choice((20, 60, 200))), 0) for i in range(300)]
    rows += [(1000 + i, text(30) + " blorgface snarkweed", 1) for i in range(120)]
    rows += [(2000 + i, text(60) + " wuxowuxo vyzavyza" * 20, 1) for i in range(2)]
    rows += [(3000 + i, text(60), 1) for i in range(40)]
    fresh = [(5000 + i, text(4000), None) for i in range(40)] + [(6000, text(200) + " wuxowuxo vyzavyza", None), (7000, text(4000) + " blorgface snarkweed" * 40, None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows + fresh], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, labels).collect()}
    assert sum(got[5000 + i] for i in range(40)) <= 2
    assert got[7000] == 1 and got[6000] == 0


def test_toxicity_of_word_families(spark):
    """Insults that take another ending in each text are found, though no form of them is frequent; words that are
    frequent themselves, and beginnings that both classes have, aren't read by their beginnings."""
    import random

    rnd = random.Random(7)
    ends = ["".join(e) for e in itertools.product("bdgmnprst", "aeiou", "klx")]
    text = lambda: " ".join(rnd.choices(["house", "river", "quiet", "birds", "mills", "trees"], k=12) + ["common" + rnd.choice(ends)])
    rows = [(i, text(), 0) for i in range(400)] + [(1000 + i, f"{text()} blorg{ends[i]} {text()}", 1) for i in range(len(ends))]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, f"{text()} blorgzzz {text()}"), (5001, text()), (5002, text().rpartition(" ")[0] + " commonzzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i] == y for i, y in held) and (got[5000], got[5001], got[5002]) == (1, 0, 0)
    assert toxicity.Families([b"blorgum"], {b"blor": 2.0, b"blorg": 3.0}).read([b"blorgum", b"blorgix", b"blorix", b"blo"]) == [b"blorgum", b"blorg-", b"blor-", b"blo"]


def test_cut():
    assert toxicity.calibrate([]) == toxicity.calibrate([(0.3, 1)]) == toxicity.FALLBACK
    assert toxicity.calibrate([(k / 100, 0) for k in range(50)] + [(0.9, 1), (0.95, 1)]) == pytest.approx((0.49 + 0.9) / 2)


PLAIN = [(1, "bad mood bad day"), (1, "a bad mood"), (1, "such a bad mood"), (0, "a good day"), (0, "good mood a day"), (0, "the day a good one"), (0, "one day")]


def plain_model(discount, prior):
    """Kneser-Ney by the formulas, over all words: log P(toxic) - log P(ordinary) of each word after a history."""
    texts_ = [(y, t.split()) for y, t in PLAIN]
    n = [sum(y == c for y, _ in texts_) for c in (0, 1)]
    d = [max(0.75, x * k) for x, k in zip(discount, n, strict=True)]
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for y, w in texts_:
        uni[y].update(set(w))
        bi[y].update(set(zip(["", *w], w, strict=False)))
    pairs = set(bi[0]) | set(bi[1])

    def word(c, w):
        total = sum(uni[c].values())
        freed = sum(min(x, d[c]) for x in uni[c].values())
        return (max(uni[c][w] - d[c], 0) + freed * sum(b == w for _, b in pairs) / len(pairs)) / total

    def p(c, h, w):
        after = {b: x for (a, b), x in bi[c].items() if a == h}
        freed, more = sum(min(x, d[c]) for x in after.values()), max(prior * n[c], 1)
        return (max(after.get(w, 0) - d[c], 0) + (freed + more) * word(c, w)) / (sum(after.values()) + more)

    return p, {b for _, b in pairs}


def test_kneser_ney(spark, monkeypatch):
    """The distributed fit against the formulas, and each class's probabilities after a history add up to one."""
    monkeypatch.setattr(toxicity, "_one_of_copies", lambda rows: rows)
    monkeypatch.setattr(toxicity.F, "pmod", lambda a, b: F.lit(1))  # all documents are learnt from
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(PLAIN)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(PLAIN)], "doc_id long, toxic int")
    model, cut = toxicity.learn(docs, labels)
    assert cut == toxicity.FALLBACK
    p, vocabulary = plain_model(toxicity.DISCOUNT, toxicity.PRIOR)
    for h in ("", "a", "bad", "day", "never"):
        for c in (0, 1):
            assert sum(p(c, h, w) for w in vocabulary) == pytest.approx(1)
    for text in ("bad mood", "a bad day", "good good mood the bad", "such one"):
        w = text.split()
        got = model.ratios([[], [x.encode() for x in w], []])
        want = [math.log(p(1, h, x) / p(0, h, x)) for h, x in zip(["", *w], w, strict=False)]
        assert got[1].tolist() == pytest.approx(want) and not len(got[0]) and not len(got[2])
        whole, passage = toxicity.normalised(got[1])
        assert whole == pytest.approx(sum(want) / len(want))
        assert passage == pytest.approx(max(sum(want[k : k + 4]) for k in range(max(len(want) - 3, 1))) / 4)


def test_one_of_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["odd"] + base[i + 1 :])) for i in range(20)] + [(100, "all different here now"), (101, ""), (102, "")]
    left = toxicity._one_of_copies(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, toxic int")).collect()
    ids = {r.doc_id for r in left}
    assert 100 in ids and len(ids & {101, 102}) == 1 and 1 <= len([i for i in ids if i < 20]) < 10


# secrets


def brute_spans(t):
    t = t or ""
    out = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, t):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_secrets(docs, none):
    got = collections.Counter((r.doc_id, tuple(map(tuple, r.secret_spans))) for r in secrets.find_secrets(docs).collect())
    assert got == collections.Counter((i, tuple(brute_spans(t))) for i, t in texts())
    assert sum(len(s) for _, s in got) >= 5
    assert secrets.find_secrets(none).count() == 0
    shown = secrets.find_secrets(docs).where("doc_id = 15").select(secrets.redact(F.col("text"), F.col("secret_spans"))).first()[0]
    assert shown == "[assign] [access] [hex]"


def test_trigram_queries():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in ("passwd=abcdef", 'API_KEY: "abcdef"', "AKIA" + "Z" * 16, "a" * 24, "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "b" * 35, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----"):
            if re.search(rule.pattern, text):
                assert any(all(g in text.lower() for g in alternative) for alternative in query), (rule, text)
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ANY
    assert secrets.trigram_query("abc|def") == frozenset([frozenset(["abc"]), frozenset(["def"])])


# exact copies


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, docs, none, keep):
    hot = spark.range(500).select((F.col("id") + 5000).alias("doc_id"), F.when(F.col("id") % 2 == 0, "Hot Copy").otherwise("hot copy").alias("text"))
    rows = texts() + [(5000 + i, "hot copy") for i in range(500)]
    df = docs.select("doc_id", "text").union(hot).repartition(7)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        best = (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None)
        want.update((i, best, len(ids), i is not None and i == best, hashlib.sha256(t).hexdigest()) for i in ids)
    assert collections.Counter(map(tuple, exact_dedup.content_sort(df, keep=keep).collect())) == want
    assert exact_dedup.content_sort(none).count() == 0


def test_groups_over_ranges(spark):
    """Groups of equal texts that lie in several ranges, between texts that begin alike: whole groups are told."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = "the very same beginning of forty letters "
        rows = [(k, same + ("COPY" if k % 3 else f"own {k % 50}")) for k in range(900)] + [(k, f"{k % 7}") for k in range(900, 950)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t.lower()].append(i)
        want = {i: (min(ids), len(ids)) for ids in groups.values() for i in ids}
        for n in ("1", "3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.content_sort(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.public_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = collections.Counter()
    for i, x in texts():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), sum(ids)] += 1
    for window, most in ((1024, 256), (16, 3)):
        pieces = packing.pack(docs, path, window=window, max_open=most).toPandas()
        assert (pieces.length > 0).all() and pieces.groupby("sequence_id").length.sum().max() <= window
        ordered = pieces.sort_values(["sequence_id", "offset"])
        assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
        assert pieces.length.sum() == sum(n * k for (_, n, _), k in want.items())
        partial = (pieces.groupby("sequence_id").length.sum() < window).groupby(lambda s: s >> 32).sum()
        assert partial.max() <= 1  # of each task
    one = packing.pack(docs.where("doc_id = 20"), path).toPandas().sort_values("start")
    ids = packing.encoder(path)(dict(texts())[20]) + bytes(4)
    assert (one.start == one.length.cumsum() - one.length).all()
    assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in one.itertuples())
    assert packing.pack(none, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_token_ids(x):
    import numpy as np

    e = packing.encoder(queries.public_tokenizer())
    assert np.frombuffer(e(x), "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_added_tokens(spark, tmp_path):
    """The registered query's ids are those of the plain tokenizer, added tokens inside texts too."""
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.public_tokenizer())
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|><|endoftext|>"), (2, "a <|endoftext| > b"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    assert len(want[0]) == 5 and len(want[1]) == 3
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in queries.op10_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_long_run_of_letters():
    e = packing.encoder(queries.public_tokenizer())
    x = "ab" * 20_000
    assert len(e(x)) == 4 * len(e.tokenizer.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("run", [packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1])
def test_both_encoders(run):
    """The two encoders give the same ids on either side of where one takes over from the other."""
    e = packing.encoder(queries.public_tokenizer())
    plain = " the words of a long text" * (packing.LONG_TEXT // 20)
    for unit in ("ab", "x", "é漢", "=-", "7"):
        x = plain + " " + (unit * run)[:run] + plain
        slow = e.tokenizer.encode(x, add_special_tokens=False).ids
        assert e.fast.encode_ordinary(x) == slow and len(e(x)) == 4 * len(slow)


def test_rule_places_most_pieces():
    """Without a bound on open windows the rule, not the end's cutting, places most pieces, and windows stay few."""
    import random

    rnd = random.Random(3)
    p, ended, most = packing.Packer(1024, None, 0), 0, 0
    for k in range(8000):
        ended += len(list(p.add((k, 0, bytes(4 * min(1024, 1 + int(rnd.lognormvariate(5.5, 1)))), 0))))
        most = max(most, p.count)
    left = len(list(p.settle()))
    assert ended > 0.85 * (ended + left) and most < 2000


def test_sum_of_squares():
    """Each placement is the one with the least sum of squared counts of partial windows."""
    p = packing.Packer(10, 100, 0)
    for size in (4, 4, 3, 6, 2, 5, 5, 1, 7, 3, 3, 4, 2, 2):
        before = p.levels[1:10].copy()
        costs = {}
        for h in range(0, 10 - size + 1):
            if h and not before[h - 1]:
                continue
            after = before.copy()
            if h:
                after[h - 1] -= 1
            if h + size < 10:
                after[h + size - 1] += 1
            costs[h] = int((after**2).sum())
        list(p.add((0, 0, bytes(4 * size), 0)))
        assert int((p.levels[1:10] ** 2).sum()) == min(costs.values())


def test_queries_are_registered():
    assert [k for k in queries.QUERIES if k.startswith("op")] == list(queries.QUERIES)
    json.dumps(queries.ORACLE_SQL)


# pieces


def test_pieces(docs, none):
    from ringfold.llm import pieces

    path = queries.public_tokenizer("piece_bpe_32k.model")
    got = pieces.encode_texts(docs, path)
    assert got.where("not round_trip").count() == 0
    assert collections.Counter(got.select("doc_id", "n_ids").where("n_ids = 0").collect()) == collections.Counter([(0, 0), (1, 0), (100, 0), (101, 0)])
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode_ids(got, path).collect())
    assert back == collections.Counter((i, t or "") for i, t in texts())
    assert pieces.encode_texts(none, path).count() == 0 and pieces.decode_ids(none.selectExpr("doc_id", "array(1) as ids"), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("the antion ▁  é\n漢\U0001f600x,.")) | st.text(max_size=20))
def test_best_pieces(x):
    """Against dynamic programming over all pieces, without automaton and chunks."""
    from ringfold.llm import pieces

    p = pieces.pieces(queries.public_tokenizer("piece_bpe_32k.model"))
    scores = {k: v[2] for k, v in p.automaton.items()}
    ids, score = p.encode(x)
    s = ("▁" + x.replace("▁", "\x00").replace(" ", "▁")) if x else ""
    best = [0.0] + [-math.inf] * len(s)
    for end in range(1, len(s) + 1):
        best[end] = best[end - 1] + p.unknown
        for start in range(max(0, end - 40), end):
            if s[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[s[start:end]])
    assert score == pytest.approx(best[-1])
    import numpy as np

    assert p.decode(np.frombuffer(ids, "<i4").tolist()) == x
