import zlib

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import langid as L
from leafmill.llm import sentencepiece_aho as A


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_do_not_matter(documents):
    out = L.held_out(F.col("doc_id"))
    a = L.language_id(documents).collect()
    b = L.language_id(documents.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_edges(edge, nothing, spark):
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in L.language_id(edge).collect()}
    assert got[1, "und"] == got[2, "und"] == got[3, "und"] == got[8, "und"] == 0.0
    assert (4, "en") in got and any(d == 7 and p != "und" for d, p in got)
    assert L.language_id(nothing).count() == 0
    plain = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.language_id(plain).first()["lang_pred"] == "und"  # nothing to learn from
    emoji = spark.createDataFrame([(1, "letters here", "en"), (3, "😀 😀", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in L.language_id(emoji).collect()}[3] == "und"


def test_mixtures():
    rng = np.random.default_rng(1)
    words = {"aa": ["abra", "alba", "bala"], "zz": ["zyx", "yzzy", "xyz"]}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    counts = np.zeros((2, L.CELLS))
    for k, name in enumerate(sorted(words)):
        for c in L.cells(say(name, 3000)):
            counts[k] += np.bincount(c, minlength=L.CELLS)
    m = L.Model(sorted(words), counts)
    assert [x for x, _ in m.languages(say("aa", 200))] == ["aa"]
    both = m.languages(say("aa", 150) + " " + say("zz", 100))
    assert {x for x, _ in both} == {"aa", "zz"} and abs(sum(s for _, s in both) - 1) < 1e-6
    assert m.languages("12 34") == []


def test_pieces_do_not_change_cells(monkeypatch):
    text = "Some Words, mit Wörtern und 😀 mehr. " * 40
    whole = np.concatenate(list(L.cells(text)))
    monkeypatch.setattr(L, "CHUNK", 100)
    assert np.concatenate(list(L.cells(text))).tolist() == whole.tolist()


def brute(a, text):
    if not text:
        return []
    known = {}
    for s in range(len(a.piece)):
        if a.piece[s] >= 0:
            known[a.pieces[a.piece[s]]] = (int(a.piece[s]), int(a.score[s]))
    s = A.MARK + text.replace(A.MARK, A.OWN_MARK).replace(" ", A.MARK)
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    raw = lambda c: (A.MARK if c == A.OWN_MARK else c).encode()
    for i in range(1, len(s) + 1):
        best[i] = best[i - 1] + len(raw(s[i - 1])) * a.byte_score
        for n in range(min(i, 64), 0, -1):
            x = known.get(s[i - n : i])
            if x and best[i - n] + x[1] > best[i]:
                best[i], back[i] = best[i - n] + x[1], (x[0], n)
    ids, i = [], len(s)
    while i:
        if back[i] is None:
            ids = [int(a.byte_ids[b]) for b in raw(s[i - 1])] + ids
            i -= 1
        else:
            ids = [back[i][0], *ids]
            i -= back[i][1]
    return ids


def test_encoding_equals_brute_force(documents, rng):
    a = A.load_automaton()
    e = A.Encoder(a)
    texts = [r["text"][:300] for r in documents.limit(60).collect()]
    texts += ["", " ", "  a  b ", "▁x ▁▁", "日本語テキスト 😀 é", "\n\n\t  x", "a" * 2000, "x" + " " * 40 + "y", "\x00\x01"]
    texts += ["".join(rng.choice("ab é▁ \n😀the") for _ in range(30)) for _ in range(200)]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == brute(a, t), t
        assert e.decode(ids) == t


def test_cuts_do_not_change_ids(monkeypatch, documents):
    a = A.load_automaton()
    texts = [r["text"] for r in documents.limit(20).collect()]
    whole = [x.tolist() for x in A.Encoder(a).encode(texts)]
    monkeypatch.setattr(A, "PIECE_CHARS", 50)
    monkeypatch.setattr(A, "KNOWN", 10)
    e = A.Encoder(a)
    assert [e.encode([t])[0].tolist() for t in texts] == whole


def test_round_trip(documents, edge, nothing):
    for df in (documents, edge):
        out = A.encode_report(df)
        assert out.where("NOT round_trip").count() == 0 and out.count() == df.count()
    back = A.decode_column(A.encode_report(edge, keep=("doc_id", "text")), to="again")
    assert back.where("NOT (text <=> again)").count() == 0
    assert A.encode_report(edge).where("doc_id = 1 AND ids IS NULL").count() == 1
    assert A.encode_report(nothing).count() == 0
