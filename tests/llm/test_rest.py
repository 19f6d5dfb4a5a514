"""Mixing, chat formatting, licences, MaxScore, and the pipeline against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import chat_format as C
from leafmill.llm import license_scan as S
from leafmill.llm import maxscore as X
from leafmill.llm import mixing as M
from leafmill.llm.registry import oracle_sql, queries

from .test_dedup import brute_components, norm, words


def targets(sizes):
    """Shares by weight; what stands above its cap is fixed there and the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if out[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **out}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(words(r["text"])) for r in rows)
    want, by_target = targets(sizes), {}
    for s, t in want.items():
        by_target.setdefault((sizes[s], round(t, 6)), [])
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == set(by_target)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    return got, sizes, want


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 50}, {"a": 5, "b": 5}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 5000}])
def test_water_filling(spark, sizes):
    sized = spark.createDataFrame([(s, n, 1024) for s, n in sizes.items()], "source string, size long, g long")
    got = {r["source"]: r["target"] for r in M.source_targets(sized).collect()}
    for s, t in targets(sizes).items():
        assert math.isclose(got[s], t, abs_tol=1e-6), (sizes, got)


def test_mix(documents, edge, nothing, spark, same_rows, rng):
    got, *_ = check_mix(documents)
    same_rows(M.mix(documents), oracle_sql()["op6_mixing"])
    check_mix(edge)
    assert M.mix(nothing).count() == 0
    rows = [(k, "w " * rng.randint(1, 60), "hot" if k % 3 else f"s{k % 7}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got, sizes, want = check_mix(df)
    source = {k: s for k, _, s in rows}
    for s in sizes:
        taken = sum(r["taken"] for r in got if source[r["doc_id"]] == s)
        assert abs(taken - want[s]) <= 61, s
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df.repartition(2)).collect()))
    again = M.mixed_documents(df)
    assert again.columns == df.columns and again.count() == sum(r["copies"] for r in got)
    assert M.mixed_documents(edge).columns == edge.columns


TURN = "pair_id long, turn long, role string, text string, part string, said int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], TURN)


def test_common_prefix(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "q"), (3, 0, "user", "same"), (4, 5, "user", None), (None, 0, "user", "x"), (2, None, "user", "x")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "same"), (5, 0, "assistant", "only"), (1, 1, "assistant", "no")]
    got = sorted((r["pair_id"], r["part"], r["turn"], r["loss"]) for r in C.format_preferences(turns(spark, a), turns(spark, b)).collect())
    assert got == [
        (1, "chosen", 1, True), (1, "chosen", 2, False), (1, "prompt", 0, False), (1, "rejected", 1, True),
        (2, "prompt", 0, False), (2, "rejected", 1, True), (3, "prompt", 0, False), (4, "chosen", 5, False), (5, "rejected", 0, True)]
    whole = {r["pair_id"]: r for r in C.assemble(C.format_preferences(turns(spark, a), turns(spark, b))).collect()}
    assert whole[1]["prompt"] == "<|user|>\nhi<|end|>\n" and whole[1]["chosen"].startswith("<|assistant|>\nyes")
    span = whole[1]["chosen_loss"][0]
    assert len(whole[1]["chosen_loss"]) == 1 and whole[1]["chosen"][span["start"] : span["stop"]] == "<|assistant|>\nyes<|end|>\n"


def test_chat_query_and_edges(spark, sf_dir, same_rows):
    same_rows(queries()["op4_chat_format"](spark, sf_dir), oracle_sql()["op4_chat_format"])
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, first int, last int")
    assert C.format_preferences(*C.repeated_answer_pairs(none)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "q", 3, 4), (1, 1, "assistant", "a", 3, 4), (2, 0, None, None, 3, 4)], "conv_id long, turn long, role string, text string, first int, last int")
    assert C.format_preferences(*C.repeated_answer_pairs(one)).count() == 0


def test_licences(documents, edge, nothing, spark):
    got = {r["doc_id"]: r for r in S.licence_report(documents).collect()}
    families = {t[0]: f for f, t in S.TEMPLATES.items()}
    for r in documents.select("doc_id", "text").collect():
        at, want = 0, []
        for line in r["text"].split("\n"):
            want += [f"{f}:{at}:{at + len(line)}" for t, f in families.items() if t in line]
            at += len(line) + 1
        assert got[r["doc_id"]]["spans"] == ",".join(want), r["doc_id"]
    assert S.licence_report(edge).where("n_licences > 0").count() == 0 and S.licence_report(nothing).count() == 0
    # Held-out wordings, and prose that only uses a licence's words.
    model = S.Classifier().fit(["plain words of no use here", "the general public was under the bridge"])
    say = lambda t: (model.classify(t, 0.9, 0.8) or [None])[0]
    assert say("* Licensed under the Apache License, Version 2.0 ; see below") == "apache"
    assert say("This project is licensed under the terms of the MIT license, as is usual") == "mit"
    assert say("The version of the general public was released under a license to drive") is None
    assert say("") is None and say("license") is None


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, score int, query_id string")


def brute_top(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_maxscore(spark, monkeypatch):
    g = np.random.default_rng(6)
    rows = [(k, g.normal(size=24).tolist()) for k in range(400)]
    rows += [(500 + k, rows[k][1]) for k in range(60)] + [(600, None), (650, []), (700, [None] * 24), (750, [float("nan")] * 24), (800, [float("inf")] * 24), (850, [1.0, 2.0]), (None, rows[0][1])]
    rows += [(900 + k, [0.5] * 24) for k in range(60)]
    df = vectors(spark, rows)
    got = lambda k: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in X.top_k(df, F.col("vec_id") % 50 == 0, k).collect())
    assert got(5) == brute_top(rows, 5)
    monkeypatch.setattr(X, "SHARD", 37)
    monkeypatch.setattr(X, "BLOCK", 3)
    assert got(5) == brute_top(rows, 5) and got(50) == brute_top(rows, 50)
    assert X.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark, sf_dir, tmp_path, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    keep = {d: r for d, r in rows.items() if any(c.isalpha() for c in r["text"])}
    first = {}
    for d in sorted(keep):
        first.setdefault(norm(keep[d]["text"]), d)
    keep = {d: keep[d] for d in first.values()}
    parts = brute_components([(d, r["text"]) for d, r in keep.items()], 5)
    keep = {d: r for d, r in keep.items() if parts[d][1] == d}
    mixed = {r["doc_id"]: r["copies"] for r in M.mix(spark.createDataFrame(list(keep.values()), docs.schema)).collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r["round_trip"]
    assert count == {d: n for d, n in mixed.items() if n}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
        assert name == "sentencepiece" or out.columns == docs.columns


def test_pipeline_stages_take_odd_rows(spark, edge, sf_dir):
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == edge.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("NOT round_trip").count() == 0
