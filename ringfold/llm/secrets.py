"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, text_of, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, then those that this method adds (fixed values).
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: Strings of one expression that are followed apart, and alternatives of one query.
MOST = 64
Query = frozenset[frozenset[str]]
#: A query that every text fulfils.
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return a if b == ANY or a != ANY else b  # weaker, and still true of every match
    return frozenset(x | y for x, y in itertools.product(a, b))


def _of(strings: set[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _node(op: object, arg: object) -> tuple[set[str] | None, Query]:
    """The lower-cased strings that a node can match, if few, and a query true of all its matches."""
    if op is K.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is K.AT:
        return {""}, ANY
    if op is K.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                chars.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < MOST:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 4 else (None, ANY)
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), ANY
        query: Query = frozenset()
        for exact, q in parts:
            query = _either(query, q if exact is None else _of(exact))
        return None, query
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, item = arg
        exact, q = _sequence(item)
        if exact is not None and most == 1:
            return exact | ({""} if not least else set()), ANY
        if exact is not None and least == most and len(exact) ** least <= MOST:
            return {"".join(x) for x in itertools.product(exact, repeat=least)}, ANY
        return None, ANY if not least else q if exact is None else _of(exact)
    return None, ANY


def _sequence(items: object) -> tuple[set[str] | None, Query]:
    whole, run, query = True, {""}, ANY
    for op, arg in items:
        exact, q = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a, b in itertools.product(run, exact)}
            continue
        query, whole = _both(_both(query, _of(run)), q), False
        run = {""} if exact is None else exact
    return (run, ANY) if whole else (None, _both(query, _of(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of trigrams, of which every match's lower-cased text holds one in full."""
    exact, query = _sequence(parser.parse(pattern))
    return query if exact is None else _of(exact)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings of the given trigrams: (trigram's number, doc_id), from lower-cased texts."""
    low = F.lower("text")
    held = F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)))
    return docs.select("doc_id", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, dict[int, int]]:
    """Documents that may match some rule, with a bit for each such rule, and the rules' bits.
    Rules without mandatory trigrams aren't among them."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    trigrams = sorted(set().union(*(t for q in queries.values() for t in q)))
    number = {t: i for i, t in enumerate(trigrams)}
    words = (len(trigrams) + 62) // 63
    bit = F.expr("shiftleft(1L, trigram % 63)")
    masks = [F.coalesce(F.bit_or(F.when((F.col("trigram") / 63).cast("int") == w, bit)), F.lit(0).cast("long")).alias(f"m{w}") for w in range(words)]
    index = trigram_index(docs, trigrams).groupBy("doc_id").agg(*masks)

    def holds(alternative: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            if need := sum(1 << number[t] % 63 for t in alternative if number[t] // 63 == w):
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == need)
        return out

    bits = {k: 1 << i for i, k in enumerate(queries)}
    found = F.lit(0)
    for k, q in queries.items():
        met = F.lit(False)
        for alternative in sorted(q, key=sorted):
            met = met | holds(alternative)
        found = found + F.when(met, F.lit(bits[k])).otherwise(F.lit(0))
    return index.select("doc_id", found.alias("rules")).where("rules <> 0"), bits


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """Leftmost matches that don't overlap, as start and end in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counts = lambda m: (F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.group else F.lit(True)
    pairs = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), counts(m).alias("ok")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(_SPAN).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``secret_spans`` to every row: an array of (start, rank, end, kind), sorted, in code points.

    From each rule's expression a Boolean query over trigrams is derived; postings of the
    trigrams are intersected by document; only documents that fulfil a rule's query are
    verified by its expression. Rules without mandatory trigrams scan all texts. DataFrame
    functions only. The candidates are written, so that their size is known when they are joined.

    Null text: no spans; texts of any length are scanned whole. Null ids are candidates together; rows of one id are
    verified each by its own text, so repeated rows give equal results; the input's other columns are kept, but
    for one named secret_spans, which is replaced. An empty table gives no rows.
    """
    rows = docs.drop("secret_spans")
    key, mask = unused("secret_id", rows.columns), unused("secret_rules", rows.columns)
    found, bits = candidates(rows.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), rules)
    found = kept(found, "candidates").select(F.col("doc_id").alias(key), F.col("rules").alias(mask))
    joined = rows.join(found, rows[id_col].eqNullSafe(found[key]), "left")
    text, none = text_of(rows[text_col]), F.array().cast(_SPAN)
    parts = []
    for k, rule in enumerate(rules):
        likely = F.col(mask).bitwiseAND(F.lit(bits[k])) != 0 if k in bits else text.rlike(rule.pattern)
        parts.append(F.when(likely, _spans(text, k, rule)).otherwise(none))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop(key, mask)


def redact(text: Column, spans: Column) -> Column:
    """The text with each secret replaced by ``[kind]``; of overlapping ones the first names the place.
    Spans are sorted; what each leaves of the text before it is one part, and the parts are joined once."""
    none = F.array().cast("array<struct<from:int,to:int,mark:string>>")
    end_before = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), F.greatest(s["start"], acc["at"]).alias("to"), F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("").alias("mark")))).alias("out")),
        lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), F.length(text).alias("to"), F.lit("").alias("mark")))),
    )
    parts = F.transform(end_before, lambda p: F.concat(F.substring(text, p["from"] + 1, p["to"] - p["from"]), p["mark"]))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
