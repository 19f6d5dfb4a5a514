import hashlib
import re

import pytest

from leafmill.llm import secret_scan as S
from leafmill.llm.trigram_query import trigram_query

BASE = [
    ("assign", re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [x for _, _, x in sorted(found)]


def check(df):
    texts = df.select("doc_id", "text").collect()
    got = S.secret_report(df).collect()
    assert len(got) == len(texts)
    want = sorted(str((r["doc_id"], hashlib.sha256(",".join(b := brute(r["text"])).encode()).hexdigest(), *[sum(x.startswith(k) for x in b) for k, *_ in BASE])) for r in texts)
    assert sorted(str((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"])) for r in got) == want


def test_documents(documents):
    check(documents)


def test_hostile_texts(spark, rng):
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc123", "AKIA", "QWERTYUIOP123456", "deadbeef" * 3, "é", "😀", "\n", "==", "a"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_edges(edge, nothing):
    check(edge)
    assert S.secret_report(nothing).count() == 0


def test_other_rules_add_spans(spark):
    text = "x ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- password=hunter22"
    row = S.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.split(":")[0] for s in row["spans"].split(",")] == ["hosttoken", "keyblock", "assign"] and row["n_assign"] == 1


@pytest.mark.parametrize("pattern, texts", [
    (r"AKIA[A-Z0-9]+", ["AKIAX"]), (r"(?i:pass(word|wd))=", ["PassWord=", "passwd="]), (r"gh[ops]_[a-z]+", ["gho_a", "ghs_z"]), (r"(abc)+d?ef", ["abcabcef", "abcdef"]),
    (r"[0-9]+abc?[xy]z", ["1abxz", "12abcyz"]), (r"ab", ["ab"]), (r"x{3}y", ["xxxy"]), (r"(?:one|two)three", ["onethree", "twothree"]),
])
def test_query_holds_for_every_match(pattern, texts):
    for t in texts:
        assert re.fullmatch(pattern, t)
        low = t.lower()
        for clause in trigram_query(pattern):
            assert any(all(g in low for g in alt) for alt in clause), (pattern, t, clause)


def test_rules_without_trigrams():
    assert trigram_query(r"[0-9a-f]+") == [] and trigram_query(r"AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
