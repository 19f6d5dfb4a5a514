"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Sizes are words. Sources, in code-point order with null last, carry repeating weights; together they
receive ``share`` times all words. A source's target stops at ``max_epochs`` times its size, and the
excess goes to the others by weight (water filling in closed form, over one row per source).

Each document of a source expects ``e`` copies, where the sum of ``e * size`` over the source is its
target: ``e = rho + tilt * min(rho, max_epochs - rho) * v``, with ``rho`` = target / size of the
source and ``v`` a zero-mean score that favours shorter documents. The whole part of ``e`` is
certain. The fraction ``p`` is an inclusion probability for Pareto order sampling: documents are
ranked by ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of doc_id and the seed, and the
smallest are taken until the source's remaining words are used up (the document at the edge is taken
if that comes nearer to the target). The sample is thus fixed in words, of which targets are made, and in
documents only where they are of one size.

Scale: a source may hold any share of the rows. The cut is found from a histogram of the ranks (at
most ``BINS`` rows per source after partial aggregation), and only documents in the one bin that
holds the cut are sorted, so no task sees a whole source. Sources are numbered and their shares found in blocks
of a range partitioning, of which only one row each meets in a task, so there may be as many as rows.

Edge cases: null text has size 0 and takes 0; very long texts are counted whole; a null source is a source of
its own, sorted last; sources of size 0 get target 0; rows that repeat a doc_id share its random number, and
rows with a null doc_id have one by their text; of equal ranks those of smaller doc_id and size come first;
rows that are equal in all of that are taken in any order, each for itself; an empty table
gives an empty result; other columns are ignored. ``mixed_documents`` repeats each row as often as the mix takes
it, whether ids repeat or are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.rows import at_places, placed, row_hash
from leafmill.llm.textnorm import text_or_empty, word_count
from leafmill.session import broadcast_if_small, materialize

BINS = 65536
#: Fixed scale of the tilt score: a document of this many words scores one half.
HALF_SIZE = 512


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with what the rows before each one, in ``order``, add up to. Two levels: rows are sorted within
    the parts of a range partitioning, and the parts' totals among themselves."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    totals = parts.groupBy("part").agg(*[F.sum(c).alias(f"{k}_part") for k, c in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = totals.select("part", *[F.coalesce(F.sum(f"{k}_part").over(earlier), F.lit(0)).alias(f"{k}_part") for k in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(totals), "part")  # one row for each part
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"{k}_part") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("part", *[f"{k}_part" for k in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source of ``sized`` (source, size, g): source, source_size, g_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("g")).alias("g_size"))
    by_name = F.col("source").asc_nulls_last()
    per = _before(per, [by_name], {"place": F.lit(1).cast("long")}, "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    per = per.withColumn("cap", max_epochs * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    per = _before(per, [F.col("level").asc(), by_name], {"capped": F.col("cap"), "weighed": F.col("weight")}, "mix-levels")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    per = per.join(F.broadcast(whole), F.lit(True), "left")  # one row
    # With the sources before this one capped, the level that the rest would share.
    shared = (share * F.col("words") - F.col("capped")) / (F.col("weights") - F.col("weighed"))
    per = materialize(per.withColumn("shared", shared), "mix-shares")
    # The water level is that of the first source that its cap does not stop.
    place = F.struct("level", F.col("source").isNull().alias("last"), "source", "shared")
    water = per.agg(F.min(F.when(F.col("shared") <= F.col("level"), place))["shared"].alias("water"))
    per = per.join(F.broadcast(water), F.lit(True), "left")  # one row
    target = F.when((F.col("water").isNull()) | (F.col("cap") <= F.col("water") * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", "g_size", target.otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    tilt: float = 0.25,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text", "source")
    return _mix(rows, weights, share, max_epochs, tilt, seed).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, tilt: float = 0.25, seed: str = "mix") -> DataFrame:
    """``mix`` of rows (doc_id, row_hash, text, source), with their row_hash."""
    size = word_count(F.col("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(text_or_empty(F.col("text")), 256)))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), named), 256), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    sized = rows.select("doc_id", "row_hash", F.col("source").cast("string").alias("source"), size.alias("size"), u.alias("u"))
    sized = materialize(sized.withColumn("g", F.floor(F.lit(1024.0 * HALF_SIZE) / (F.col("size") + HALF_SIZE)).cast("long")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, max_epochs), "mix-targets")

    def with_source(df: DataFrame, per: DataFrame) -> DataFrame:
        per = per.withColumnRenamed("source", "s")
        return df.join(broadcast_if_small(per), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    rho = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    v = (F.col("g") - F.when(F.col("source_size") > 0, F.col("g_size") / F.col("source_size")).otherwise(F.lit(0.0))) / 1024.0
    rows = with_source(sized, targets).withColumn("rho", rho)
    rows = rows.withColumn("e", F.col("rho") + tilt * F.least(F.col("rho"), max_epochs - F.col("rho")) * v)
    rows = rows.withColumn("sure", F.floor("e")).withColumn("p", F.col("e") - F.col("sure"))
    q = F.when(F.col("p") > 0, (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p"))))
    rows = rows.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1.0 + F.col("q")) * BINS))

    # Words per rank bin and source, then the bin where the source's remaining words run out.
    sure = rows.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    bins = rows.where("q IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    need = targets.join(sure, targets["source"].eqNullSafe(sure["source"]), "left").select(targets["source"], (F.col("target") - F.coalesce("sure_words", F.lit(0))).alias("need"))
    need = materialize(need, "mix-need")
    cut = with_source(bins, need).where("upto > need").groupBy("source").agg(F.min(F.struct("bin", "before")).alias("cut"))
    cut = materialize(cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before")), "mix-cut")

    joined = with_source(with_source(rows, need), cut)
    edge = joined.where("bin = cut_bin")
    ranked = Window.partitionBy("source").orderBy("q", "doc_id", "size")
    edge = edge.withColumn("upto", F.col("cut_before") + F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("more", (F.col("upto") + F.col("upto") - F.col("size") <= 2 * F.col("need")).cast("long"))
    rest = joined.where("bin IS NULL OR cut_bin IS NULL OR bin <> cut_bin").withColumn("upto", F.lit(0).cast("long"))
    rest = rest.withColumn("more", F.when(F.col("q").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1).otherwise(0).cast("long"))
    both = rest.unionByName(edge).withColumn("copies", F.col("sure") + F.col("more"))
    return both.select("doc_id", "row_hash", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` itself with each row as often as the mix takes it; its columns stay as they are. Rows that are
    equal in all columns are counted together, since nothing tells them apart."""
    taken = _mix(docs.select("doc_id", row_hash(docs).alias("row_hash"), "text", "source"), **settings)
    taken = taken.groupBy(F.col("doc_id").alias("place_id"), F.col("row_hash").alias("place_hash"))
    taken = materialize(taken.agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).where("copies > 0"), "mix-taken")
    rows = placed(docs)
    # The mix takes a part of all rows, so this is a join of large tables at any size.
    once = at_places(rows, taken.where("rows = 1").drop("rows"), "inner", few=False).select("row", "copies")
    several = materialize(taken.where("rows > 1").drop("rows"), "mix-repeated")
    again = at_places(rows, several, "left_semi").groupBy("doc_id", "row_hash").agg(F.first("row").alias("row"))
    again = at_places(again, several, "inner").select("row", "copies")
    return once.unionByName(again).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, named, source, size, CAST(floor(1024.0::DOUBLE * 512 / (size + 512)) AS BIGINT) AS g FROM (
    SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text ' || sha256(coalesce(text, ''))) AS named, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents)),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * g) AS BIGINT) AS g_size FROM sized GROUP BY source),
w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS cap FROM per),
lv AS (
  SELECT *, cap / weight AS level FROM w),
rem AS (
  SELECT *, row_number() OVER (ORDER BY level, source NULLS LAST) AS place, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0) AS lft,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS rest
  FROM lv WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wat AS (
  SELECT *, arg_min(lft / rest, place) FILTER (WHERE lft / rest <= level) OVER () AS water FROM rem),
targets AS (
  SELECT source, source_size, g_size,
         CASE WHEN water IS NULL OR cap <= water * weight THEN cap ELSE water * weight END AS target FROM wat),
joined AS (
  SELECT s.*, t.source_size, t.g_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rho,
         (CAST(('0x' || substr(sha256('mix:' || named), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
exp AS (
  SELECT *, rho + 0.25::DOUBLE * least(rho, 2.0::DOUBLE - rho)
    * ((g::DOUBLE - CASE WHEN source_size > 0 THEN g_size::DOUBLE / source_size::DOUBLE ELSE 0.0::DOUBLE END) / 1024.0::DOUBLE) AS e
  FROM joined),
parts AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS sure, e - floor(e) AS p FROM exp),
ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q,
         target - CAST(sum(sure * size) OVER (PARTITION BY source) AS DOUBLE) AS need FROM parts),
upto AS (
  SELECT *, CAST(sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM ranked),
took AS (
  SELECT *, sure + CASE WHEN q IS NOT NULL AND upto + upto - size <= 2 * need THEN 1 ELSE 0 END AS copies FROM upto)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM took
"""
