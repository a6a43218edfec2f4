"""Two profiles of modes compared field by field.

Modes meet by their normalised name (lower case, blanks collapsed); the fields of a mode are a map, and two maps are zipped
by field. Defined cases: a null map has no fields; a null value is a field like any other; of modes with one name the last by spelling counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), r"\s+", " "))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (mode, fields map<string,string>): mode, status (added, removed, changed, same), fields: each with what became of it, by name."""
    side = lambda rows: rows.groupBy(normal_name(F.col("mode")).alias("key")).agg(F.max(F.struct("mode")).getField("mode").alias("mode"), F.max_by("fields", "mode").alias("fields"))
    a, b = side(old).alias("a"), side(new).alias("b")
    rows = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    was, now = F.coalesce("a.fields", empty), F.coalesce("b.fields", empty)
    there = lambda fields, k: F.map_contains_key(fields, k)
    fate = lambda k, x, y: F.when(~there(was, k), "added").when(~there(now, k), "removed").when(~x.eqNullSafe(y), "changed")
    told = F.map_filter(F.map_zip_with(was, now, fate), lambda _, v: v.isNotNull())
    labels = F.array_sort(F.transform(F.map_entries(told), lambda e: F.concat_ws(" ", e["key"], e["value"])))
    status = F.when(F.col("a.key").isNull(), "added").when(F.col("b.key").isNull(), "removed").when(F.size(labels) > 0, "changed").otherwise("same")
    return rows.select(F.coalesce("b.mode", "a.mode").alias("mode"), status.alias("status"), F.when(status == "changed", labels).otherwise(F.array().cast("array<string>")).alias("fields"))
