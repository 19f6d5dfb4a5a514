"""Repeated and null ids: dedup, near-duplicates, mixing and the pipeline's stages against row-by-row models."""

from collections import Counter

import numpy as np

import corpus_pipeline
from leafmill.llm import exact_dedup as E
from leafmill.llm import minhash as M
from leafmill.llm import mixing as X

from .test_dedup import norm, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, grp string"


def passage(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def table(spark, rng):
    """Texts with exact and near copies, under ids that repeat with the same and with other texts, and null ids."""
    texts = []
    for _ in range(12):
        base = passage(rng, 60)
        for k in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(k % 3):
                t[rng.randrange(60)] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(t))
    texts += [texts[0].replace(" ", "  "), texts[3], "", None, " ", "short one", "short  one"]
    rows = []
    for n, t in enumerate(texts * 2):
        rows.append((rng.choice([None, n, n % 9, 3]), t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or ""), "r", "g"))
    rows += rows[:9]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def counted(rows):
    return Counter(tuple(r) for r in rows)


def by_place(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def components(rows, width, percent=80):
    """The component of each row (by position), rows with an empty set alone."""
    sets = [shingles(r[1], width) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, s in enumerate(sets):
            for j, t in enumerate(sets[:i]):
                if s and t and label[i] != label[j] and 100 * len(s & t) >= percent * len(s | t):
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    return sets, label


def test_one_of_equal_texts(spark, rng):
    rows, df = table(spark, rng)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    got = E.deduplicated(df).collect()
    assert len(got) == len(groups)
    for r in got:
        own = groups.pop(norm(r["text"]))
        assert tuple(r) in own and r["doc_id"] == by_place(own)[0][0]
    assert not groups
    assert E.deduplicated(df.limit(0)).count() == 0
    assert counted(corpus_pipeline.one_of_equal_texts(spark, df, "").collect()) == counted(got)


def test_near_rows(spark, rng):
    rows, df = table(spark, rng)
    sets, label = components(rows, 2)
    least = {}
    for r, c in zip(rows, label):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    want = Counter((r[0], len(s), least.get(c) if s else r[0], (least.get(c) if s else r[0]) == r[0]) for r, s, c in zip(rows, sets, label))
    assert Counter(map(tuple, M.near_duplicates(df, 2).select("doc_id", "n_shingles", "component_id", "kept").collect())) == want


def test_one_row_of_near_rows(spark, rng):
    rows, df = table(spark, rng)
    sets, label = components(rows, 5)
    groups = {}
    for r, s, c in zip(rows, sets, label):
        groups.setdefault(c if s else ("alone", id(r), len(groups)), []).append(r)
    got = M.representatives(df, 5).collect()
    assert len(got) == len(groups)
    whole = {tuple(r): c for r, c in zip(rows, label)}
    for r in got:
        if shingles(r["text"], 5):
            own = groups.pop(whole[tuple(r)])
            assert r["doc_id"] == by_place(own)[0][0]
    assert all(isinstance(c, tuple) for c in groups)
    assert M.representatives(df.limit(0), 5).count() == 0


def test_a_repeated_id_loses_no_link(spark):
    a, b = " ".join(f"a{k}" for k in range(41)), " ".join(f"b{k}" for k in range(41))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, b + " else"), (None, "all alone here")]
    got = Counter(map(tuple, M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("doc_id", "component_id", "kept").collect()))
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True)])


def test_mix_counts_rows(spark, rng):
    rows, df = table(spark, rng)
    taken = X.mix(df).collect()
    mixed = X.mixed_documents(df)
    assert mixed.columns == df.columns
    got = counted(mixed.collect())
    assert sum(got.values()) == sum(r["copies"] for r in taken)
    assert got.keys() <= counted(rows).keys()
    for r, n in counted(rows).items():
        assert got[r] <= 2 * n
    assert sum(len(words(r[1])) * n for r, n in got.items()) == sum(r["taken"] for r in taken)
    nulls = spark.createDataFrame([(None, f"word{k} again", None, "s", 3, "r", "g") for k in range(100)], SCHEMA)
    assert X.mixed_documents(nulls).count() == sum(r["copies"] for r in X.mix(nulls).collect()) == 150


def test_many_sources(spark):
    """Shares of thousands of sources, which no window gathers, equal those by iteration."""
    from .test_rest import targets

    g = np.random.default_rng(3)
    sizes = {f"host{k:05d}": int(n) for k, n in enumerate(g.pareto(1.0, 3000) * 10 + 1)}
    sized = spark.createDataFrame([(s, n, 1024) for s, n in sizes.items()], "source string, size long, g long")
    got = {r["source"]: r["target"] for r in X.source_targets(sized).collect()}
    want = targets(sizes)
    assert all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in want.items())


def test_filter_bytes():
    """A merged shelf takes fewer bytes an entry than a whole fingerprint, and long counts survive."""
    g = np.random.default_rng(1)
    shelf_bits, bits = E.filter_bits(256_000)
    keys = np.unique(g.integers(0, 1 << (bits - shelf_bits), 8000).astype(np.uint64))
    counts = np.ones(len(keys), np.int64)
    counts[::50] = g.integers(2, 1 << 40, len(counts[::50]))
    row = E.encode(keys, counts, bits - shelf_bits)
    assert sum(len(x) for x in row[2:]) < 8 * len(keys)
    back = E.decode(*row)
    assert (back[0] == keys).all() and (back[1] == counts).all()
    for n in (0, 1, 2, 7):
        for width in (1, 8, 9, 33, 64):
            own = np.unique(g.integers(0, 1 << min(width, 62), n).astype(np.uint64))
            many = g.integers(1, 1 << 50, len(own))
            back = E.decode(*E.encode(own, many, width))
            assert (back[0] == own).all() and (back[1] == many).all()
