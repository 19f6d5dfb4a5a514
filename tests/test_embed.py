"""The default embedding: tokens end at ASCII white space only, and each is hashed once while it is remembered."""

import hashlib

import numpy as np

from leafmill.operators import embed as E


def test_places_are_those_of_the_md5_and_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(E, "_PLACES", {})
    monkeypatch.setattr(E.hashlib, "md5", lambda b, f=hashlib.md5: hashed.append(b) or f(b))
    texts = ["B a\x0bb\x85c a", None, " \t", "İ \ud800 a b"]
    got = E.hash_embed(texts)
    want = np.zeros((4, 64))
    for row, tokens in enumerate([["b", "a", "b\x85c", "a"], [], [], ["İ".lower(), "\ud800", "a b"]]):
        for t in tokens:
            h = hashlib.new("md5", t.encode("utf-8", "surrogatepass")).hexdigest()
            want[row, int(h[:4], 16) % 64] += 1 if h[4] < "8" else -1
    norm = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert np.allclose(got, want / np.where(norm > 0, norm, 1))
    assert all(isinstance(b, bytes) for b in E._PLACES[64])
    assert len(hashed) == len(set(hashed)) == 6
