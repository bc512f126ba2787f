"""Several values packed in one field: infer the delimiters of each source, split, explode with position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import BROADCAST_ROWS, cut, small

#: The separators that are tried, as they are written in regular expressions; blanks may surround each.
CANDIDATES = {"bar": r"\|", "semicolon": ";", "comma": ",", "slash": "/", "broken_bar": "¦", "blank": r"\s"}


@dataclass(frozen=True)
class ItemForm:
    """How an item begins: `name` and the sign that ends the name. A piece that doesn't begin so continues the item before it."""

    name: str
    sign: str

    @property
    def start(self) -> str:
        return f"{self.name}{self.sign}"


#: Name=Value, the name in letters and digits starting with a capital, perhaps with a [layer].
FEATURE = ItemForm(r"\p{Lu}[\p{L}\p{N}]*(?:\[[\p{L}\p{N}]+\])?", "=")
#: number:relation, the number perhaps like 5.1.
DEPENDENCY = ItemForm(r"[0-9]+(?:\.[0-9]+)?", ":")

_DQ, _SQ = '"[^"]*"', "'[^']*'"


#: Any run of separators and blanks.
_ANY = "[\\s|;,/¦]"
#: The character of each candidate that can be hidden, and the private character that stands for it meanwhile.
_CHARS = {"bar": "|", "semicolon": ";", "comma": ",", "slash": "/", "broken_bar": "¦", "blank": " "}
_VEIL = {c: chr(0xE000 + i) for i, c in enumerate(_CHARS.values())}

#: A candidate separates in a source if its score there reaches this bar.
LEAST_SCORE = 0.003
#: So many pieces and fields of the whole collection's rate are added to a source's own before its rates are taken.
PRIOR = 50
#: So many pieces that are no items are added to the whole collection's before its regularity is taken.
POOL_PRIOR = 10


def unwrap(c: Column) -> Column:
    """Trim a field and take off quotes that enclose all of it, with doubled quotes inside them undone."""
    c = F.trim(c)
    double = F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')
    single = F.regexp_replace(F.regexp_replace(c, "^'|'$", ""), "''", "'")
    in_double = c.startswith('"') & c.rlike('^"(?:[^"]|"")*"$')
    in_single = c.startswith("'") & c.rlike("^'(?:[^']|'')*'$")
    return F.when(in_double, double).when(in_single, single).otherwise(c)


def _item_pattern(form: ItemForm) -> str:
    """One item: quoted as a whole, or its start and then quoted stretches and other characters up to separators that an item start follows."""
    stop = f"""(?!{_ANY}+["']?{form.start})"""
    item = f"""(?:"{form.start}[^"]*"|'{form.start}[^']*'|["']?{form.start}(?:{_DQ}|{_SQ})?)"""
    return f"{item}(?:{stop}[\\s\\S])*"


def _clean(form: ItemForm, piece: Column) -> Column:
    """An item without the separators that trail it and without the quotes around it or its value."""
    p = F.regexp_replace(piece, f"{_ANY}+$", "")
    whole = f"""^(?:"({form.start}[^"]*)"|'({form.start}[^']*)'|["']?({form.start})(?:"([^"]*)"|'([^']*)'))"""
    unquoted = F.regexp_replace(F.regexp_replace(p, whole, "$1$2$3$4$5"), r"""^["'\s]+|["'\s]+$""", "")
    return F.when(p.rlike("[\"']"), unquoted).otherwise(p)


def _cleaned(form: ItemForm, pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.translate(_clean(form, x), "".join(_VEIL.values()), "".join(_VEIL)))


def delimiter_scores(df: DataFrame, source: str, fields: dict[str, ItemForm]) -> DataFrame:
    """Score every candidate separator for every source and field, over all rows.

    Quoted stretches are masked, then a field is reduced to the separators in it (`plain`) and those before an item start
    (`cuts`). `regularity` is cuts / plain: how many of the pieces that the candidate makes are items. `consistency` is
    alone / several: the share of the fields with several items in which the candidate alone makes as many pieces as there
    are item starts. `score` is the product of both after PRIOR pieces and fields at the rate of the whole collection are
    added to the source's own (the collection's regularity is itself taken over POOL_PRIOR more pieces, none an item). So a
    separator that the collection uses is believed where it is rare, and one that a stray row shows is believed nowhere.

    One scan; layouts are counted map-side, so what is shuffled is the few distinct layouts; the result has at most
    (sources x fields x candidates) rows. Null and unspecified fields count for nothing; a null source is a source.
    """
    names = list(fields)
    held = df.select(F.col(source).alias("source"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(names)])
    bare = {}
    for i, f in enumerate(names):
        v = F.col(f"v{i}")
        whole = F.when(v.rlike("[\"']"), F.regexp_replace(unwrap(v), f"(?<=^|[=:\\s|;,/¦])({_DQ}|{_SQ})", "Q")).otherwise(F.trim(v))
        bare[f"b{i}"] = F.when(v.isNotNull() & ~v.isin("", "_"), whole)
    cells = []
    for i, (f, form) in enumerate(fields.items()):
        start = f"""(?:Q|["']?{form.start})"""
        cuts = F.array_join(F.regexp_extract_all(f"b{i}", F.lit(f"({_ANY}+)(?={start})"), F.lit(1)), "\u0001")
        cells.append(F.struct(F.lit(f).alias("field"), cuts.alias("cuts"), F.regexp_replace(f"b{i}", f"[^|;,/¦\\s]+", "\u0001").alias("plain")))
    layout = held.select("source", *[c.alias(n) for n, c in bare.items()]).select("source", F.inline(F.array(*cells))).filter("plain is not null")
    layout = layout.groupBy("source", "field", "cuts", "plain").agg(F.count(F.lit(1)).alias("n"))
    seps = F.split("cuts", "\u0001")
    several = F.col("cuts") != ""
    parts = []
    for k, s in CANDIDATES.items():
        # blanks beside another separator belong to that separator
        alone = "^\\s+$" if k == "blank" else f"^\\s*(?:{s}\\s*)+$"
        made = _matching(seps, alone)
        there = _matching(F.split("plain", "\u0001"), alone)
        parts.append(F.struct(F.lit(k).alias("delimiter"), F.when(several, made).otherwise(0).alias("cuts"), there.alias("plain"), F.when(several & (made == F.size(seps)), 1).otherwise(0).alias("alone")))
    n = F.col("n")
    counted = (
        layout.select("source", "field", "n", several.cast("int").alias("several"), F.explode(F.array(*parts)).alias("r"))
        .groupBy("source", "field", F.col("r.delimiter").alias("delimiter"))
        .agg(F.sum(n * F.col("r.cuts")).alias("cuts"), F.sum(n * F.col("r.plain")).alias("plain"), F.sum(n * F.col("r.alone")).alias("alone"), F.sum(n * F.col("several")).alias("several"))
    )
    counted = cut(counted, "delimiters")
    pooled = counted.groupBy(F.col("field").alias("f"), F.col("delimiter").alias("d")).agg(
        (F.sum("cuts") / (F.sum("plain") + POOL_PRIOR)).alias("pr"), F.coalesce(F.sum("alone") / F.nullif(F.sum("several"), F.lit(0)), F.lit(0.0)).alias("pc")
    )
    j = counted.join(F.broadcast(pooled), (F.col("field") == F.col("f")) & (F.col("delimiter") == F.col("d")))
    regular = (F.col("cuts") + PRIOR * F.col("pr")) / (F.col("plain") + PRIOR)
    consistent = (F.col("alone") + PRIOR * F.col("pc")) / (F.col("several") + PRIOR)
    return j.select(
        "source", "field", "delimiter", "cuts", "plain", "alone", "several",
        F.when(F.col("plain") > 0, F.least(F.lit(1.0), F.col("cuts") / F.col("plain"))).otherwise(0.0).alias("regularity"),
        F.when(F.col("several") > 0, F.col("alone") / F.col("several")).otherwise(0.0).alias("consistency"),
        (F.least(F.lit(1.0), regular) * consistent).alias("score"),
    )


def _matching(pieces: Column, pattern: str) -> Column:
    return F.size(F.filter(pieces, lambda x: x.rlike(pattern)))


def accepted_delimiters(scores: DataFrame, fields: list[str]) -> DataFrame:
    """One row per source; for each field the separators whose score reaches LEAST_SCORE (best first) and the characters of the others."""
    chars = F.create_map(*[F.lit(x) for k, c in _CHARS.items() for x in (k, c)])
    aggs = []
    for f in fields:
        mine = F.col("field") == f
        good = F.col("score") >= LEAST_SCORE
        ranked = F.array_sort(F.collect_list(F.when(mine & good, F.struct((-F.col("score")).alias("s"), F.col("delimiter").alias("d")))))
        never = F.array_join(F.array_sort(F.collect_list(F.when(mine & ~good, chars[F.col("delimiter")]))), "")
        aggs += [F.transform(ranked, lambda x: x["d"]).alias(f"delimiters_{f}"), never.alias(f"hide_{f}")]
    return scores.groupBy("source").agg(*aggs)


def _hidden(v: Column, hide: Column) -> Column:
    """v with the characters of `hide` replaced by private ones; blanks only where they stand between two pieces with no other separator there."""
    inner = F.regexp_replace(v, f"(?<=[^\\s|;,/¦]\\s{{0,99}})\\s(?=\\s*[^\\s|;,/¦])", _VEIL[" "])
    v = F.when(F.contains(hide, F.lit(" ")), inner).otherwise(v)
    others = F.replace(hide, F.lit(" "), F.lit(""))
    return F.call_function("translate", v, others, F.call_function("translate", others, F.lit("".join(_VEIL)), F.lit("".join(_VEIL.values()))))


def split_packed(df: DataFrame, keys: list[str], source: str, fields: dict[str, ItemForm], scored: DataFrame | None = None) -> DataFrame:
    """Every item of the packed `fields` as its own row: keys, field, pos (from 1), item.

    The separators of a source are chosen first by their scores (delimiter_scores over all rows of `scored`, by default of
    df; accepted_delimiters). A field is cut where a chosen separator stands outside quotes before an item start, so pieces
    that aren't items stay with the item before them, separator included, and fields that mix chosen separators are
    followed too. Separators that weren't chosen are ordinary characters in that source. Quotes around a field, an item or
    a value are taken off. Null, empty and `_` fields give no rows; text before the first item start is no item; repeated
    rows are split as often as they occur; a source that `scored` lacks is cut by every candidate.
    """
    names = list(fields)
    accepted = accepted_delimiters(delimiter_scores(scored if scored is not None else df, source, fields), names)
    accepted = F.broadcast(accepted) if small(accepted, BROADCAST_ROWS // 10) else accepted
    base = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(source).alias("s"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(names)])
    joined = base.join(accepted, F.col("s").eqNullSafe(F.col("source")), "left")
    cells = []
    for i, (f, form) in enumerate(fields.items()):
        given = F.col(f"v{i}").isNotNull() & ~F.trim(f"v{i}").isin("", "_")
        hide = F.coalesce(F.col(f"hide_{f}"), F.lit(""))
        hidden = F.when(hide == "", F.col(f"v{i}")).otherwise(_hidden(F.col(f"v{i}"), hide))
        found = F.regexp_extract_all(unwrap(hidden), F.lit(_item_pattern(form)), F.lit(0))
        cleaned = _cleaned(form, found)
        cells.append(F.struct(F.lit(f).alias("field"), F.when(given, cleaned).alias("items")))
    out = joined.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.array(*cells)).alias("cell"))
    out = out.select(*keys, F.col("cell.field").alias("field"), F.posexplode("cell.items").alias("p", "item"))
    return out.select(*keys, "field", (F.col("p") + 1).cast("int").alias("pos"), "item")
