"""The registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import BOS, EOS, MARKS, format_chats, loss_text
from .common import LOWER, UPPER, table
from .exact_dedup import content_sort
from .jaccard import jaccard_join
from .lm import score_texts
from .packing import pack
from .pieces import encode_texts
from .quality import quality_rules
from .secrets import BASE, MORE, find_secrets, span_list
from .sharding import shard
from .toxicity import score_toxicity


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    chats = format_chats(turns.union(planted)).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


#: Chosen on the held-out fold, see the README.
PRIORS = (500.0, 50.0)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), order=3, prior=PRIORS)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_list(F.filter("secret_spans", lambda s: s["rank"] < len(BASE)))
    return out.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("secret_spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer(), added=True)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_lm_scoring, op3_ngram_jaccard_join, op4_sharding, op5_quality_rules, op6_sentencepiece, op7_toxicity, op8_secret_scans, op9_exact_dedup, op10_packing)}

_MARK_CHARS = " ".join(f"when '{r}' then {len(m)}" for r, m in MARKS.items())
_ESCAPE = r"regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')"



def _secret_sql() -> str:
    parts = []
    for k, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        ok = f"length(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}" if r.group else "true"
        parts.append(f"""
select doc_id, {k} as rank, '{r.kind}' as kind, i, {ok} as ok, length(m[i]) as n,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
from (select doc_id, m, p, unnest(range(1, len(m) + 1)) as i from (
  select doc_id, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as p from documents where regexp_matches(text, '{p}')))""")
    return f"""
with found as ({" union all ".join(parts)}),
spans as (select doc_id, rank, kind, start, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as span from found where ok),
by_doc as (select doc_id, {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)},
  string_agg(span, ',' order by start, rank) filter (where rank < {len(BASE)}) as base, string_agg(span, ',' order by start, rank) as spans from spans group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join by_doc b on d.doc_id = b.doc_id"""


#: All pairs of a group appear in the SQL's links, which the operator never writes.
_JACCARD_SQL = f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, cast(len(s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) as component_id
from s left join reach on a = s.doc_id group by s.doc_id, len(s)"""

ORACLE_SQL = {
    "op3_ngram_jaccard_join": _JACCARD_SQL,
    "op8_secret_scans": _secret_sql(),
    "op1_chat_formatting": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u as (select *, {len(BOS) + len(EOS)} + case role {_MARK_CHARS} else 13 + length(role) end + length({_ESCAPE}) as shown from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(shown) as bigint) as formatted_chars, true as round_trip
from u group by conv_id""",
    "op9_exact_dedup": f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from n window w as (partition by t)""",
}
