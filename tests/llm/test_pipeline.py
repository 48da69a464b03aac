"""The pipeline's stages against plain versions of what they decide."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from ringfold.llm import packing, secrets
from ringfold.llm.queries import public_tokenizer
from test_operators import brute_groups


def source():
    """Ordinary texts, toxic ones, copies, near copies, secrets, nulls and empties."""
    rows, labels = [], []
    for i in range(150):
        text = f"the house near river {i} was quiet and {i * 7 % 13} birds sang over mills " + " ".join(f"w{i}_{j}" for j in range(40))
        rows.append((i, text))
        rows.append((1000 + i, "you blorgface " + text.replace("w", "v") + " snarkweed"))
        labels += [(i, 0), (1000 + i, 1)]
    base = dict(rows)
    rows += [(2000 + i, base[i].upper()) for i in range(20)]
    rows += [(3000 + i, base[i + 30].replace(f"w{i + 30}_39", "changed")) for i in range(20)]
    rows += [(4000, base[60] + " extra words password=hunter22 and AKIA" + "B" * 16 + " more"), (5000, None), (5001, ""), (5002, None)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = source()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        out[name] = at
    texts = {k: {r.doc_id: r.text for r in df.collect()} for k, df in out.items() if k != "packing"}
    for name in texts:
        assert out[name].columns == docs.columns

    clean = {i: t for i, t in rows if not 1000 <= i < 2000}
    assert texts["toxicity"] == clean

    first = {}
    for i, t in sorted(clean.items()):
        first.setdefault((t or "").encode().lower(), i)
    unique = {i: t for i, t in clean.items() if i in first.values()}
    assert texts["exact_dedup"] == unique

    groups = {i: c for i, _, c in brute_groups(list(unique.items()), 5, 80)}
    near = {i: t for i, t in unique.items() if groups[i] == i}
    assert texts["near_dedup"] == near and len(near) < len(unique)

    def cut(t):
        spans = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least)
        done, shown = 0, ""
        for start, _, end, kind in spans:
            shown += t[done : max(start, done)] + (f"[{kind}]" if start >= done else "")
            done = max(done, end)
        return shown + t[done:]

    assert texts["secret_scans"] == {i: None if t is None else cut(t) for i, t in near.items()}
    assert out["secret_scans"].where(F.col("n_chars") != F.length(F.coalesce("text", F.lit("")))).count() == 0

    encode = packing.encoder(public_tokenizer())
    want = sum(len(encode(t or "")) // 4 + 1 for t in texts["secret_scans"].values())
    pieces = out["packing"].toPandas()
    assert pieces.length.sum() == want and set(pieces.doc_id) == set(near)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == want


def test_dedup_of_rows(spark):
    """Repeated rows, copies without id, and an id with two texts: one row of each text stays."""
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a written twice"), (1, "A written twice"), (None, "a written twice"), (2, "first"), (3, "first"), (3, "only here"), (None, "nobody's"), (None, "nobody's")]
    rows += [(4, near), (4, near + " end"), (5, near + " start"), (None, near + " other"), (6, "only six"), (5, "another of five")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns
    want = [(1, "a written twice"), (2, "first"), (3, "only here"), (None, "nobody's"), *rows[8:]]
    key = lambda r: (r[0] or 0, r[1].lower())
    lower = lambda rs: sorted(((i, t.lower()) for i, t in rs), key=key)
    assert lower((r.doc_id, r.text) for r in exact.collect()) == lower(want)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, exact, "").collect()]
    group = [r for r in left if r[1].startswith(near)]
    assert len(group) == 1 and group[0][0] == 4
    assert lower(r for r in left if r not in group) == lower(r for r in want if not r[1].startswith(near))


def test_awkward_tables(spark, tmp_path):
    """Empty tables, null ids, repeated rows and columns that clash with inner names, in every stage."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone long, secret_spans string, _secret_id int, _passage double, row long, `group` string, node string"
    rest = ("en", "s", None, "mine", 7, "mine", 7, 0.5, 7, "mine", "mine")
    texts = [(1, "same words here"), (1, "same words here"), (None, "same words here"), (None, None), (2, None), (3, ""), (4, "password=hunter22 " * 300), (5, "w" * 50_000), (None, "only this")]
    docs = spark.createDataFrame([(i, t, *rest) for i, t in texts], schema)
    left = {"toxicity": 9, "exact_dedup": 5, "near_dedup": 9, "secret_scans": 9}
    for name, stage in corpus_pipeline.STAGES:
        for df, rows in ((docs, left.get(name)), (docs.where("false"), 0)):
            out = stage(spark, df, str(tmp_path))
            if name == "packing":
                assert out.select("doc_id").distinct().count() == (6 if rows is None else 0)
                continue
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            found = out.collect()
            # near_dedup ties the three rows of equal words.
            assert len(found) == (7 if name == "near_dedup" and rows else rows)
            assert all(tuple(r)[5:] == rest[3:] for r in found)
    shown = [r.text for r in corpus_pipeline.secret_scans(spark, docs, str(tmp_path)).collect()]
    assert "[assign] " * 300 in shown and shown.count(None) == 2
