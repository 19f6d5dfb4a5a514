"""Rows of a table by what they hold, where no column is a key.

A row is located by its doc_id, which may be null or repeated, and a hash of what it holds. Two rows with one
location are equal in all that the hash covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import broadcast_if_small, materialize


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash and the whole row as a struct, whose names cannot clash with others."""
    return docs.select(F.col("doc_id"), row_hash(docs).alias("row_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def at_places(rows: DataFrame, places: DataFrame, how: str, few: bool = True) -> DataFrame:
    """``rows`` joined with ``places`` (place_id, place_hash and more) by location, null ids included. Where places
    are ``few`` at most sizes, they are broadcast if their count allows it."""
    same = rows["doc_id"].eqNullSafe(places["place_id"]) & (rows["row_hash"] == places["place_hash"])
    return rows.join(broadcast_if_small(places) if few else places, same, how)


def keep_one(docs: DataFrame, crowd: DataFrame) -> DataFrame:
    """``docs`` with one row left of each group in ``crowd`` (doc_id, row_hash, grp: the rows of all groups of
    two rows or more): that of smallest doc_id (null last), then of smallest hash. Rows that are equal in all
    columns share a location; of these too one stays. Other rows pass untouched.

    Whole rows are shuffled only where locations outgrow a broadcast; equal rows are aggregated before they
    are shuffled, so no group, however large, meets in a task."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    first = crowd.groupBy("grp").agg(F.min(place).alias("w")).select(F.col("w.doc_id").alias("place_id"), F.col("w.row_hash").alias("place_hash"))
    first = materialize(first, "first-rows")
    crowd = materialize(crowd.select(F.col("doc_id").alias("place_id"), F.col("row_hash").alias("place_hash")).distinct(), "crowd")
    rows = placed(docs)
    rest = at_places(rows, crowd, "left_anti").select("row.*")
    won = at_places(rows, first, "left_semi").groupBy("doc_id", "row_hash").agg(F.first("row").alias("row"))
    return rest.unionByName(won.select("row.*"))
