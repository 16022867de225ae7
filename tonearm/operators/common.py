"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def credits(t, key: str = "canonical_track_id") -> DataFrame:
    """artists: id and name of the credits, by position, for each recording's chosen copy or each track or album."""
    table = {"canonical_track_id": "canonical_track_artists", "track_id": "track_artists", "album_id": "album_artists"}[key]
    rows = t[table].where("on_representative") if table == "canonical_track_artists" else t[table]
    named = rows.join(t["artists"].select(F.col("id").alias("artist_id"), "name"), "artist_id")
    listed = F.array_sort(F.collect_list(F.struct("position", F.col("artist_id").alias("id"), "name")))
    return named.groupBy(key).agg(F.transform(listed, lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"))).alias("artists"))


def with_credits(rows: DataFrame, t, key: str = "canonical_track_id") -> DataFrame:
    """rows with artists. The credits of these rows only are gathered; rows without credits have an empty list."""
    wanted = rows.select(key).distinct()
    listed = credits(_Only(t, wanted, key), key)
    empty = F.array().cast("array<struct<id:string,name:string>>")
    return rows.join(listed, key, "left").withColumn("artists", F.coalesce("artists", empty))


class _Only:
    """Tables of which the credits are those of some keys."""

    def __init__(self, t, wanted: DataFrame, key: str) -> None:
        self.t, self.wanted, self.key = t, wanted, key

    def __getitem__(self, name: str) -> DataFrame:
        return self.t[name] if name == "artists" else self.t[name].join(self.wanted, self.key, "left_semi")


def first_artist(t, key: str) -> DataFrame:
    """key, artist_id and artist: the first credit of each track or album."""
    table = {"track_id": "track_artists", "album_id": "album_artists"}[key]
    first = t[table].groupBy(key).agg(F.min_by("artist_id", F.struct("position", "artist_id")).alias("artist_id"))
    return first.join(t["artists"].select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id")


def thumbs(images: DataFrame, key: str, least_width: int = 200) -> DataFrame:
    """key and cover: the smallest image of enough width, else the smallest of all."""
    order = F.struct(F.coalesce(F.col("width") < least_width, F.lit(True)), F.coalesce("width", F.lit(0)), "position")
    return images.groupBy(key).agg(F.min_by("url", order).alias("cover"))


def real_albums(t) -> DataFrame:
    """Albums that aren't compilations; those of unknown type stay."""
    return t["albums"].where(~F.col("album_type").eqNullSafe("compilation"))


def paged(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """One page and total, the number of rows on all pages.

    The total is an aggregate of its own, not a window over all rows, so that only the page is sorted in
    full and the rest is cut by top-k. counted: as many rows as rows has, before joins that only add columns.
    """
    counted = (rows if counted is None else counted).agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)
    return page.crossJoin(F.broadcast(counted))  # one row


def parallel_rows(rows: DataFrame, *arrays: str) -> DataFrame:
    """A row for each place of the arrays, side by side; shorter arrays end in nulls, rows without items give none."""
    kept = [c for c in rows.columns if c not in arrays]
    return rows.select(*kept, F.explode(F.arrays_zip(*arrays)).alias("_item")).select(*kept, *(F.col("_item")[a].alias(a) for a in arrays))


def sort_key(sorts: dict[str, str], key: str, direction: str = "desc") -> Column:
    """A whitelisted sort; an unknown key is the first one, nulls stand last."""
    column = F.col(sorts.get(key, next(iter(sorts.values()))))
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()


def filtered(rows: DataFrame, filters: dict[str, str] | None, clauses: dict[str, dict[str, str]]) -> DataFrame:
    """rows under the chosen filters; a filter or value that isn't in the vocabulary doesn't filter."""
    for name, value in (filters or {}).items():
        clause = clauses.get(name, {}).get(value)
        if clause is not None:
            rows = rows.where(clause)
    return rows


def ranked(rows: DataFrame, by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def month_spine(spark, low, high) -> DataFrame:
    """m: the first days of all months from one date to another, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(low), "month"), F.trunc(F.lit(high), "month"), F.expr("interval 1 month"))).alias("m"))
