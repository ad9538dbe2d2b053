"""Which column of a file a wanted column name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinefuse.functions.payload import first_name_ending
from kinefuse.schemas import ROLES


def _last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def match_tier(column: Column, wanted: Column) -> Column:
    """How well a column fits a wanted name, ignoring case: 1 best, 4 weakest, null not at all.

    1 equal, 2 one is a dotted suffix of the other, 3 equal last parts, 4 one last part inside the other.
    """
    have, want = F.lower(column), F.lower(wanted)
    dot = F.lit(".")
    suffix = F.endswith(want, F.concat(dot, have)) | F.endswith(have, F.concat(dot, want))
    have_base, want_base = _last_part(have), _last_part(want)
    inside = F.contains(have_base, want_base) | F.contains(want_base, have_base)
    return (
        F.when(wanted == "", F.lit(None).cast("int"))
        .when(have == want, 1)
        .when(suffix, 2)
        .when(have_base == want_base, 3)
        .when(inside, 4)
    )


def resolve_in(columns: Column, wanted: Column) -> Column:
    """Best-fitting name in an ordered array of names; the earlier one wins within a tier."""

    def candidate(name: Column, place: Column) -> Column:
        tier = match_tier(name, wanted)
        return F.when(
            tier.isNotNull(), F.struct(tier.alias("tier"), place.alias("place"), name.alias("name"))
        )

    best = F.array_min(F.transform(columns, candidate))
    return F.when(wanted.isNotNull(), best["name"])


def resolve_on_row(df: DataFrame) -> DataFrame:
    """Replace the six role columns by the paths of the file's own `columns` (name, path).

    Adds the paths of its location columns as `lat_col` and `lon_col`.
    """
    names = F.array_distinct("columns.name")
    found = {**{role: resolve_in(names, F.col(role)) for role in ROLES}, **location_columns(names)}

    def path(name: Column) -> Column:
        """Where one name is both a plain key and a nested one, the longer path; it reads both."""
        fitting = F.filter("columns", lambda c: c["name"] == name)
        ranked = F.transform(fitting, lambda c: F.struct(F.size(c["path"]).alias("size"), c["path"].alias("path")))
        return F.array_max(ranked)["path"]

    return df.withColumns(found).withColumns({c: path(F.col(c)) for c in found})


def location_columns(names: Column) -> dict[str, Column]:
    """First names, in order, that end in `lat` and `lon`."""
    return {"lat_col": first_name_ending(names, "lat"), "lon_col": first_name_ending(names, "lon")}


def file_columns(events: DataFrame, keys: tuple[str, ...] = ("source", "file_path")) -> DataFrame:
    """Columns of each file from event rows: one row per (file, name) with the place it first appears.

    Rows are first reduced to the distinct key lists of a file, so only those are taken apart.
    """
    lists = events.groupBy(*keys, F.map_keys("payload").alias("names")).agg(
        F.min("position").alias("position")
    )
    listed = lists.select(*keys, "position", F.posexplode("names").alias("place", "name"))
    return listed.groupBy(*keys, "name").agg(F.min(F.struct("position", "place")).alias("ordinal"))


def resolve_by_file(
    columns: DataFrame, maps: DataFrame, keys: tuple[str, ...] = ("source", "file_path")
) -> DataFrame:
    """Resolution from (file, name, ordinal) rows: per file the six resolved roles and location columns.

    `maps` should be a written table (`storage.write_and_read`), so that the join knows its size.

    The choice is a minimum of (tier, ordinal, name), which combines before the shuffle; no file's
    columns are gathered or sorted in one place.
    """
    wanted = maps.select("source", *[F.col(r).alias(f"wanted_{r}") for r in ROLES])
    joined = columns.join(wanted, "source")

    def best(role: str) -> Column:
        tier = match_tier(F.col("name"), F.col(f"wanted_{role}"))
        ranked = F.struct(tier.alias("tier"), F.col("ordinal"), F.col("name"))
        return F.min(F.when(tier.isNotNull(), ranked))["name"].alias(role)

    def ending(suffix: str) -> Column:
        fits = F.endswith(F.lower("name"), F.lit(suffix))
        return F.min(F.when(fits, F.struct("ordinal", "name")))["name"].alias(f"{suffix}_col")

    return joined.groupBy(*keys).agg(*[best(r) for r in ROLES], ending("lat"), ending("lon"))
