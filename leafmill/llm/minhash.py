"""Near-duplicate detection with HyperMinHash signatures.

Every distinct word shingle is hashed once to 64 bits. The top 8 bits name one of 256 buckets; of the
smallest remainder in a bucket the register keeps the leading-zero count (6 bits) and the next 10 bits
(the mantissa), 16 bits in all. Buckets that stay empty borrow from another one by a fixed probe order,
so that two registers agree with probability close to the Jaccard similarity at any set size. 42 bands
of 6 compressed registers make candidates: at similarity 0.8 a pair shares no band with probability
(1 - 0.8**6)**42, about 3e-6. A candidate pair of large sets is dropped when its collision-corrected
estimate lies more than 0.2 under the threshold (over seven standard deviations); all others are
verified on the full shingle sets of the whole texts.

Rows with one and the same shingle set form a class, which gets a number of its own when the classes are
written; classes, not copies, are compared, and neither null nor repeated ids matter to that. In each
band bucket every class is compared with one pivot (which differs from band to band). After the
components of the confirmed links are known, the only open pairs are those of a bucket whose members
lie in different components. The members of such buckets are written as differences from a center (a class of
the bucket's largest component), and pairs are generated through shared differences (see ``_open_pairs``), so that no link of a bucket
is lost while a large group of near copies does not make all its pairs.

Scale: band keys, pivots, links and labels are grouped minima and equi-joins; no bucket, group or
component is gathered in a task or on the driver. Broadcasts are of id lists whose row count is
checked first.

Edge cases: null and blank texts have an empty set and link with nothing; a text with fewer words than
the shingle width is one shingle; rows with a null doc_id are linked like others, but name no component, so
one whose component holds no id has component_id null and is kept; rows that repeat a doc_id with other
texts each link by their own text, and rows that repeat a doc_id and a text share their result; ties have no
effect; very long texts count whole; an empty table gives an empty result; other columns are ignored.
``representatives`` leaves one row of every component, also where ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.llm.rows import keep_one, row_hash
from leafmill.llm.word_hash import mix64, shingle_set, word_hashes
from leafmill.session import broadcast_if_small, materialize

REGISTERS = 256
MANTISSA = 10
ROWS, BANDS = 6, 42

SIG_SCHEMA = "doc_id long, row_hash long, n_shingles long, set_a long, set_b long, sig binary"


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each register the order in which it looks for a register to borrow from."""
    return np.stack([np.argsort(mix64(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1000 * (i + 1)))) for i in range(REGISTERS)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16) of non-empty sorted sets of 64-bit hashes."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for d, u in enumerate(sets):
        at = np.append(np.searchsorted(u, bounds), len(u))
        full[d] = at[:-1] < at[1:]
        least[d] = u[np.minimum(at[:-1], len(u) - 1)]
    rest = least << np.uint64(8)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 63)
    tail = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    regs = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    d, b = np.nonzero(~full)
    probes, t = _probes(), 0
    while len(d):
        src = probes[b, t]
        ok = full[d, src]
        regs[d[ok], b[ok]] = regs[d[ok], src[ok]]
        d, b, t = d[~ok], b[~ok], t + 1
    return regs


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (doc_id, row_hash, text) without the text, with n_shingles, a 128-bit hash of the shingle set, and
    the packed registers (null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for first, words in word_hashes(texts):
                sets = [shingle_set(w, width) for w in words]
                n = np.array([len(s) for s in sets], np.int64)
                sig: list[bytes | None] = [None] * len(sets)
                some = np.flatnonzero(n)
                for k, r in zip(some, registers([sets[i] for i in some]), strict=True):
                    sig[k] = r.astype(">u2").tobytes()
                code = [[mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets] for salt in (0x5BD1E995, 0x1B873593)]
                code = [np.array(c, np.uint64).view(np.int64) for c in code]
                own = [batch.column(k).slice(first, len(sets)) for k in (0, 1)]
                cols = [*own, pa.array(n), pa.array(code[0]), pa.array(code[1]), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_hash", "n_shingles", "set_a", "set_b", "sig"])

    return rows.select("doc_id", "row_hash", "text").mapInArrow(sign, SIG_SCHEMA)


@lru_cache(maxsize=4096)
def _by_chance(load_a: int, load_b: int) -> float:
    """Probability that registers of two unrelated buckets with that many elements agree."""
    z = np.arange(1, 57)[:, None]
    m = np.arange(1 << MANTISSA)[None, :]
    low = 2.0 ** -z * (1 + m / (1 << MANTISSA))
    high = 2.0 ** -z * (1 + (m + 1) / (1 << MANTISSA))
    part = lambda n: (1 - low) ** n - (1 - high) ** n
    return float((part(max(load_a, 1)) * part(max(load_b, 1))).sum())


def estimate(sig_a: bytes, sig_b: bytes, n_a: int, n_b: int) -> float:
    """Jaccard similarity from the share of equal registers, corrected for chance agreement."""
    equal = float((np.frombuffer(sig_a, ">u2") == np.frombuffer(sig_b, ">u2")).mean())
    chance = _by_chance(round(n_a / REGISTERS), round(n_b / REGISTERS))
    return max(0.0, (equal - chance) / (1 - chance))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that size and estimate leave possible."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(2, 6)]
            keep = [min(na, nb) < REGISTERS or estimate(sa, sb, na, nb) >= percent / 100 - 0.2 for sa, sb, na, nb in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = classes.join(broadcast_if_small(materialize(_both(pairs), "pair-ids")), "cls", "left_semi").select("cls", "n_shingles", "sig")
    left, right = (own.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return joined.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(test, "a long, b long")


def _both(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The distinct classes (cls) in two columns of ``pairs``."""
    return pairs.select(F.col(a).alias("cls")).unionByName(pairs.select(F.col(b).alias("cls"))).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for k in range(0, len(left), 256):
                both = left[k : k + 256] + right[k : k + 256]
                sets = [shingle_set(w, width) for _, run in word_hashes(both) for w in run]
                for s, t in zip(sets[: len(sets) // 2], sets[len(sets) // 2 :], strict=True):
                    shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = _texts(rows, classes, _both(pairs))
    left, right = (own.select(F.col("cls").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(test, "a long, b long")


def _texts(rows: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """cls and text of the classes that ``ids`` (cls) names, once each: the text of the row by which a class is
    located. They are written, so that joins with them begin at an exchange, whose large partitions can be split."""
    wanted = classes.join(broadcast_if_small(materialize(ids, "ids")), "cls", "left_semi")
    wanted = materialize(wanted.select("cls", F.col("at.doc_id").alias("at_id"), F.col("at.row_hash").alias("at_hash")), "places")
    same = rows["doc_id"].eqNullSafe(wanted["at_id"]) & (rows["row_hash"] == wanted["at_hash"])
    return materialize(rows.join(broadcast_if_small(wanted), same).select("cls", "text").dropDuplicates(["cls"]), "texts")


def _open_pairs(groups: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and candidate pairs in groups of classes around a center (center, cls, comp).

    Let D(x) be the symmetric difference of x and the center p, k(x) = |D(x)| - f |x| with
    f = (100 - percent) / (100 + percent), and K = f |p|. Two documents are linked exactly when
    2 |D(x) and D(y)| >= k(x) + k(y), and x is linked with p exactly when k(x) <= K; k(y) >= -K always
    holds. So a pair that is not joined through p has one member with k(x) > K, and shares at least
    (k(x) - K) / 2 > 0 elements of D(x), and (k(y) + K) / 2 of D(y). By the prefix principle it agrees
    in an element among the first |D| - need + 1 of both, in an order common to the group: elements
    that p lacks first, which few documents share. At an element with r elements of D(x) behind it, 2 (1 + r)
    bounds the left side; where no partner's k is low enough for that, a row makes no pairs. In a group of
    near copies, or of texts that all lack the same part of p, this leaves a small part of all pairs, and no
    link is lost."""
    f = (100 - percent) / (100 + percent)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for at in range(0, len(left), 256):
                both = left[at : at + 256] + right[at : at + 256]
                sets = [shingle_set(w, width) for _, run in word_hashes(both) for w in run]
                for s, p in zip(sets[: len(sets) // 2], sets[len(sets) // 2 :], strict=True):
                    added, gone = np.setdiff1d(s, p, assume_unique=True), np.setdiff1d(p, s, assume_unique=True)
                    delta = np.concatenate([added, gone]).view(np.int64)
                    k, limit = len(delta) - f * len(s), f * len(p)
                    first = lambda need, d=delta: d[: max(0, len(d) - max(1, int(np.ceil(need - 1e-9))) + 1)]
                    linked = k <= limit + 1e-9
                    out.append((len(s), len(delta), k, linked, first((k + limit) / 2), None if linked else first((k - limit) / 2)))
            n, d, k, linked, y, x = zip(*out, strict=True) if out else ((),) * 6
            longs = pa.list_(pa.int64())
            cols = [pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.float64()), pa.array(linked, pa.bool_()), pa.array(y, longs), pa.array(x, longs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["center", "cls", "comp", "n", "d", "k", "linked", "y", "x"])

    own = _texts(rows, classes, _both(groups, "cls", "center"))
    joined = groups.join(own, "cls").join(own.select(F.col("cls").alias("center"), F.col("text").alias("text_p")), "center")
    joined = joined.select("center", "cls", "comp", "text", "text_p")
    parts = joined.mapInArrow(part, "center long, cls long, comp long, n long, d long, k double, linked boolean, y array<long>, x array<long>")
    parts = materialize(parts, "deltas")
    near = parts.where("linked AND cls <> center").select(F.greatest("cls", "center").alias("a"), F.least("cls", "center").alias("b"))
    side = lambda e: parts.select(
        "center", *[F.col(c).alias(f"{c}_{e}") for c in ("cls", "comp", "n", "d", "k")], F.posexplode(e).alias("pos", "item")
    ).withColumn(f"rest_{e}", F.col(f"d_{e}") - F.col("pos") - 1).drop("pos", f"d_{e}")
    keys = ["center", "item"]

    def possible(e: str, other: str) -> DataFrame:
        """Rows of a side for which some partner at their element could do."""
        best = side(other).groupBy(*keys).agg(F.min(f"k_{other}").alias("low_k"), F.max(f"rest_{other}").alias("most"))
        best = materialize(best, "partners")
        return side(e).join(best, keys).where(f"2 * (1 + least(rest_{e}, most)) >= k_{e} + low_k - 1e-6").drop("low_k", "most")

    # At the first element that a pair shares, no more than the elements behind it can follow.
    left, right = materialize(possible("x", "y"), "open-x"), materialize(possible("y", "x"), "open-y")
    pairs = left.join(right, keys).where(
        f"""comp_x <> comp_y AND 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)
            AND 2 * (1 + least(rest_x, rest_y)) >= k_x + k_y - 1e-6"""
    )
    pairs = pairs.select(F.greatest("cls_x", "cls_y").alias("a"), F.least("cls_x", "cls_y").alias("b"))
    return near, pairs.distinct()


def _verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    likely = materialize(_likely(materialize(pairs, "pairs"), classes, percent), "likely")
    return materialize(_confirmed(likely, classes, rows, width, percent), "links")


def _centers(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """For each component of ``labels`` (id, component) the class of smallest doc_id (center): where ids are given in
    order of time, the text that others are copies of, to which their differences are smallest. Any other choice gives
    the same links, by more pairs."""
    placed = labels.select(F.col("id").alias("cls"), "component").join(classes.select("cls", "at"), "cls")
    return placed.groupBy("component").agg(F.min(F.struct("at", "cls"))["cls"].alias("center"))


def _linked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``rows`` (doc_id, row_hash, text) without the text: n_shingles and the component's number (null for an
    empty set), with the smallest doc_id of the component."""
    sig = materialize(signatures(rows, width), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    same_set = ["set_a", "set_b", "n_shingles"]
    classes = sig.where("n_shingles > 0").groupBy(*same_set).agg(F.min(first).alias("at"), F.first("sig").alias("sig"))
    # The number is unique however often a task is run, and fixed once it is written.
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    bands = classes.select("cls", "n_shingles", F.explode(keys).alias("key"))
    code = F.col("cls").bitwiseXOR(F.col("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(code).alias("code")).where("size > 1")
    pivots = buckets.select("key", F.col("code").bitwiseXOR(F.col("key")).alias("pivot"))
    # Written first, the grouped side of each join on a bucket's key comes from an exchange of its own,
    # so that adaptive execution can split a hot bucket.
    members = materialize(bands.join(materialize(pivots, "pivots"), "key"), "members")

    ordered = (F.greatest("cls", "pivot").alias("a"), F.least("cls", "pivot").alias("b"))
    tried = materialize(members.where("cls <> pivot").select(*ordered).distinct(), "star-pairs")
    links = _verify(tried, classes, rows, width, percent)
    labels = materialize(connected_components(links), "labels")

    # What is left: pairs that share a bucket and lie in different components.
    known = labels.select(F.col("id").alias("cls"), "component")
    inside = members.join(known, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    open_keys = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    inside = materialize(inside.join(materialize(open_keys, "open-keys"), "key"), "open-members")
    tally = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = tally.groupBy("key").agg(F.max(F.struct("n", (-F.col("comp")).alias("low"))).alias("main")).select("key", (-F.col("main.low")).alias("component"))
    centers = broadcast_if_small(materialize(_centers(classes, labels), "centers"))
    main = main.join(centers, "component", "left").select("key", F.coalesce("center", "component").alias("center"))
    groups = inside.join(materialize(main, "main"), "key").select("center", "cls", "comp").distinct()
    near, open_pairs = _open_pairs(materialize(groups, "groups"), classes, rows, width, percent)
    more = _verify(open_pairs, classes, rows, width, percent).unionByName(near)
    stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labels = materialize(connected_components(stars.unionByName(more)).select(F.col("id").alias("cls"), "component"), "components")

    ids = classes.select(*same_set, "cls", F.col("at.doc_id").alias("low"))
    least = labels.join(ids.select("cls", "low"), "cls").groupBy("component").agg(F.min("low").alias("least_id"))
    labels = labels.join(broadcast_if_small(materialize(least, "least-ids")), "component")
    named = ids.join(materialize(labels, "labels"), "cls", "left")
    named = named.select(*same_set, F.coalesce("component", "cls").alias("component"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least_id")).alias("least_id"))
    return sig.drop("sig").join(named, same_set, "left")


def _with_hash(docs: DataFrame, of: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of.alias("row_hash"), F.col("text"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept. Documents
    are linked when 100 * |A and B| >= percent * |A or B| over their ``width``-word shingle sets."""
    linked = _linked(_with_hash(docs, F.xxhash64("text")), width, percent)
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    out = linked.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each component: that of smallest doc_id, null last.
    Documents with an empty set all stay."""
    linked = _linked(_with_hash(docs, row_hash(docs)), width, percent)
    linked = materialize(linked.where("component IS NOT NULL").select("doc_id", "row_hash", F.col("component").alias("grp")), "linked")
    grown = linked.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    return keep_one(docs, linked.join(broadcast_if_small(materialize(grown, "grown")), "grp", "left_semi"))


ORACLE = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM sized
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT sized.doc_id, n AS n_shingles, c AS component_id, sized.doc_id = c AS kept
FROM sized JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = sized.doc_id
"""
