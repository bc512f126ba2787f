"""Entity-attribute-value rows into one typed row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import BROADCAST_ROWS, small

#: What reads as true and as false, without case.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

#: A whole number from 0 up in any usual writing: sign +, leading zeros, thousands in groups, a fraction of zeros.
_WHOLE = r"^\+?([0-9]+|[0-9]{1,3}(?:[ ,'_][0-9]{3})+)(?:\.0*)?$"


def name_key(c: Column) -> Column:
    """What is compared of a name or a category value: letters and digits in lower case, without a leading namespace."""
    bare = F.regexp_replace(F.trim(c), r"^(?:[\p{L}\p{N}_-]+\s*[.:]+\s*)+(?=[\s\p{Punct}]*[\p{L}\p{N}])", "")
    return F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""))


def whole_number(c: Column) -> Column:
    """The plain digits of a whole number from 0 up, null for anything else; any length."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, _WHOLE, 1), r"[^0-9]", ""), r"^0+(?=[0-9])", "")
    return F.when(t.rlike(_WHOLE), digits)


def flag_value(c: Column) -> Column:
    """'true' or 'false' from the usual words, letters, 1 and 0; null for anything else, signed numbers too."""
    t = F.lower(F.regexp_replace(c, r"""^[\s"'(\[]+|[\s"')\].!]+$""", ""))
    return F.when(t.isin(*TRUE_WORDS), F.lit("true")).when(t.isin(*FALSE_WORDS), F.lit("false"))


def resolve_pairs(rows: DataFrame, inventory: DataFrame, attr: str = "attr", val: str = "val") -> DataFrame:
    """rows with `attr_known` (the inventory's spelling, null if unknown) and `val_read` (the value as the inventory spells it, null if unreadable).

    inventory: attr, val_type (category, whole, flag), val, long_name. It is one row per attribute after grouping, so it
    is broadcast once its size is checked. A whole number is read from its digits or from a long name, never from the
    digits that are left when sign, point or words around them are dropped: -2, 4.5, 1.2 and (2) are none. Columns of rows
    that are named like the new ones are replaced.
    """
    rows = rows.drop("attr_known", "val_read")
    inv = inventory.filter("attr is not null").withColumn("__vk", name_key(F.col("val"))).withColumn("__lk", name_key(F.col("long_name")))
    pairs = F.collect_list(F.when(F.col("val").isNotNull(), F.array(F.struct(F.col("__vk").alias("k"), F.col("val").alias("v")), F.struct(F.col("__lk").alias("k"), F.col("val").alias("v")))))
    listed = F.filter(F.flatten(pairs), lambda x: x["k"].isNotNull() & (x["k"] != ""))
    known = inv.groupBy(name_key(F.col("attr")).alias("__key")).agg(
        F.min("attr").alias("attr_known"), F.min("val_type").alias("__type"), listed.alias("__pairs"), F.collect_set("val").alias("__vals"),
        F.collect_set(F.when(F.col("val").isNotNull() & (F.col("__lk") != ""), F.struct(F.col("__lk").alias("k"), F.col("val").alias("v")))).alias("__longs"),
    )
    known = F.broadcast(known) if small(known, BROADCAST_ROWS) else known
    joined = rows.withColumn("__key", name_key(F.col(attr))).join(known, "__key", "left")
    v = F.col(val)
    key = name_key(v)
    by_name = F.get(F.filter("__pairs", lambda p: p["k"] == key), F.lit(0))["v"]
    by_long = F.get(F.array_sort(F.filter("__longs", lambda p: (p["k"] == key) & key.rlike(r"\p{L}"))), F.lit(0))["v"]
    number = whole_number(v)
    as_whole = F.when(F.size("__vals") == 0, number).when(F.array_contains("__vals", number), number).otherwise(by_long)
    read = F.when(F.col("__type") == "category", by_name).when(F.col("__type") == "whole", as_whole).when(F.col("__type") == "flag", flag_value(v))
    return joined.withColumn("val_read", read).drop("__key", "__type", "__pairs", "__vals", "__longs")


def attribute_columns(inventory: DataFrame) -> list[tuple[str, str, str]]:
    """(attribute, column name, Spark type) for each known attribute; the inventory bounds this list."""
    types = {"category": "string", "whole": "decimal(38,0)", "flag": "boolean"}
    found = inventory.filter("attr is not null").groupBy("attr").agg(F.min("val_type").alias("t")).orderBy("attr").collect()
    return [(r["attr"], "".join(ch if ch.isalnum() else "_" for ch in r["attr"]).strip("_").lower(), types.get(r["t"], "string")) for r in found]


def pivot_typed(rows: DataFrame, inventory: DataFrame, entity: str, attr: str, val: str, order: list[str]) -> DataFrame:
    """One row per entity: `cells` (map attribute -> value as text), one typed column per attribute, and `unread` (map attribute -> text).

    Of several readable values of an attribute the latest by `order` counts (a null is the earliest, ties go to the larger
    value). First every (entity, attribute) is brought down to one value by a map-side maximum, then those few pairs form
    the entity's map, so an entity that holds a third of all rows never meets in one task as rows. `unread` keeps, for each
    known attribute without a readable value, its latest text that failed to be read (cast failures); `failures` lists all
    of them. A whole number of more than 38 digits is null in its typed column but kept in `cells`. Rows of unknown
    attributes fill nothing; a null entity has no row; an entity without any readable or unreadable known pair has no row.
    """
    r = resolve_pairs(rows.select(F.col(entity).alias("__e"), F.col(attr).alias("attr"), F.col(val).alias("val"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]), inventory)
    r = r.filter("__e is not null and attr_known is not null")
    when = [F.col(f"__o{i}").alias(f"o{i}") for i in range(len(order))]
    one = r.groupBy("__e", "attr_known").agg(
        F.max(F.when(F.col("val_read").isNotNull(), F.struct(*when, F.col("val_read").alias("v")))).alias("got"),
        F.max(F.when(F.col("val_read").isNull() & F.col("val").isNotNull(), F.struct(*when, F.col("val").alias("v")))).alias("bad"),
    )
    one = one.filter("got is not null or bad is not null")
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("got").isNotNull(), F.struct(F.col("attr_known").alias("key"), F.col("got.v").alias("value"))))))
    unread = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("got").isNull() & F.col("bad").isNotNull(), F.struct(F.col("attr_known").alias("key"), F.col("bad.v").alias("value"))))))
    maps = one.groupBy("__e").agg(cells.alias("cells"), unread.alias("unread"))
    typed = [F.expr(f"try_cast(cells[{_quote(a)}] as {t})").alias(c) for a, c, t in attribute_columns(inventory)]
    return maps.select(F.col("__e").alias(entity), "cells", *typed, "unread")


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cells_of(wide: DataFrame, entity: str) -> DataFrame:
    """The filled cells of pivot_typed back as rows: entity, attr, val."""
    return wide.select(entity, F.explode("cells").alias("attr", "val"))


def failures(rows: DataFrame, inventory: DataFrame, attr: str = "attr", val: str = "val") -> DataFrame:
    """All rows that fill no cell, with the reason: no name, unknown attribute, no value, unreadable value. A column `reason` of rows is replaced."""
    r = resolve_pairs(rows.drop("reason"), inventory, attr, val)
    blank = F.coalesce(F.trim(F.col(attr)), F.lit("")) == ""
    reason = F.when(blank, "no name").when(F.col("attr_known").isNull(), "unknown attribute").when(F.coalesce(F.trim(F.col(val)), F.lit("")) == "", "no value").otherwise("unreadable value")
    return r.filter("val_read is null").withColumn("reason", reason).drop("val_read")


