"""Visually identical text in different characters: one skeleton for all texts that look the same."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import BROADCAST_ROWS, cut, small

#: Letters of other scripts (and script g) and the Latin letter that each looks like, with the case that each
#: has; they go before the table of the Unicode security data, which knows only one prototype for I, l and 1.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "օ": "o", "ս": "u", "հ": "h",
}

#: A class with more documents goes by broadcast when classes are joined back; 1 in HOT_CLASS documents bounds their number.
HOT_CLASS = 100_000

#: Forms of the hyphen.
HYPHENS = "‐‑⁃﹣－"

#: Characters that show nothing although their category isn't Cf.
UNSEEN = "͏ᅟᅠㅤﾠ឴឵"


#: Letters of the IPA that are forms of a plain Latin letter. Other Latin letters (dotless i, o with stroke, ae) stay themselves.
LATIN_FORMS = {"ɑ": "a", "ɡ": "g"}

#: The letters of Lisu, which have one case and the shapes of Latin capitals.
_LISU = range(0xA4D0, 0xA4F8)


def prototype(ch: str, confusable: dict[str, str] | None = None, letters: bool = True) -> str:
    """What a character of decomposed text looks like: itself, another string, or nothing.

    confusable: letters of other scripts and their prototypes (confusables); without it only LOOK_ALIKES are known. With
    letters=False no letter is taken for another, only width, ligatures, blanks, hyphens and unseen characters are settled.
    """
    if letters and (ch in LOOK_ALIKES or ch in LATIN_FORMS):
        return LOOK_ALIKES.get(ch) or LATIN_FORMS[ch]
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    code = ord(ch)
    if kind == "Cf" or ch in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180D:
        return ""
    if kind == "Cc":
        return ch if ch in "\t\n\r" else ""
    if kind == "Zs":
        return " "
    how = unicodedata.decomposition(ch)
    # width, ligatures, letters and digits of mathematical alphabets, Roman numerals; not raised or circled ones
    if how.startswith(("<wide>", "<narrow>", "<font>")) and kind[0] in "LN" or how.startswith("<compat>") and (kind == "Nl" or "LIGATURE" in unicodedata.name(ch, "")):
        return "".join(prototype(c, confusable, letters) for c in unicodedata.normalize("NFKD", ch))
    return (confusable or {}).get(ch, ch)


@cache
def _cased_letters() -> tuple[str, ...]:
    """The letters of scripts with two cases, and of Lisu, outside Latin, that no rule of `prototype` settles."""
    out = []
    for code in range(0x370, 0x20000):
        ch = chr(code)
        if (unicodedata.category(ch) in ("Lu", "Ll") or code in _LISU) and not unicodedata.decomposition(ch) and not unicodedata.name(ch, "LATIN").startswith("LATIN"):
            out.append(ch)
    return tuple(out)


def confusables(spark: SparkSession) -> dict[str, str]:
    """The letters of other scripts that look like another letter, and their prototypes, from the Unicode security data that Spark's own ICU library carries.

    Taken are letters of scripts with two cases (Greek, Cyrillic, Armenian, Coptic, Cherokee, ...) and of Lisu whose prototype is one
    character, with or without marks. The data have one prototype for I, l and 1 and one for O and 0, so a capital goes to I
    or O. Left out are Latin letters (dotless i is another letter than i), scripts without case (Arabic alef is no l to its
    readers), and pairs of letters (yu is no lo). The table depends on the Unicode version of that library and on nothing else;
    it has some hundred entries.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters, out = _cased_letters(), {}
    for i in range(0, len(letters), 1_000):
        some = letters[i : i + 1_000]
        for ch, to in zip(some, checker.getSkeleton("\n".join(some)).split("\n"), strict=True):
            if to != ch and unicodedata.category(to[0])[0] in "LN" and all(unicodedata.combining(c) for c in to[1:]):
                out[ch] = "I" if to == "l" and unicodedata.category(ch) != "Ll" else to
    # a prototype is put through the table too, so that one pass is enough
    return {ch: "".join(prototype(c, out) for c in unicodedata.normalize("NFD", to)) for ch, to in out.items()}


class _Prototypes(dict):
    """The look-alike table, filled by rule as characters are met."""

    def __init__(self, confusable: dict[str, str] | None = None, letters: bool = True):
        super().__init__()
        self.confusable, self.letters = confusable, letters

    def __missing__(self, code: int) -> str:
        self[code] = out = prototype(chr(code), self.confusable, self.letters)
        return out

    def __reduce__(self):
        return _Prototypes, (self.confusable, self.letters)


def look_alike_table(spark: SparkSession) -> _Prototypes:
    """The whole table for skeleton(): the fixed values, the rules and the Unicode security data."""
    return _Prototypes(confusables(spark))


_TABLE = _Prototypes()
#: The table that leaves letters what they are.
FORMS = _Prototypes(letters=False)
_ODD_ASCII = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def skeleton(text: str, table: dict[int, str] = _TABLE) -> str:
    """Decompose, put every character's prototype in its place, decompose again. table: look_alike_table(); the default lacks the Unicode security data."""
    if text.isascii():
        return _ODD_ASCII.sub("", text)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_skeleton(df: DataFrame, text: str = "text", to: str = "skeleton") -> DataFrame:
    """df with the skeleton of a text column; null for null, empty for texts that show nothing at all."""

    table = look_alike_table(df.sparkSession)

    @F.pandas_udf("string")
    def of(s):
        return s.map(lambda t: skeleton(t, table), na_action="ignore")

    return df.withColumn(to, of(F.col(text)))


def skeleton_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, look, exact: 16-byte digests of skeleton and text. Null texts and texts without a visible character are left out."""
    table = look_alike_table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, looks, exacts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    s = skeleton(t, table)
                    if s and not s.isspace():
                        ids.append(i), looks.append(_digest(s)), exacts.append(_digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(exacts, pa.binary())], names=["doc_id", "look", "exact"])

    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    return src.mapInArrow(run, "doc_id bigint, look binary, exact binary")


def look_alike_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """look, n_texts, n_docs, first_doc: the groups of documents that look the same, only digests and counts are shuffled."""
    return _groups(skeleton_keys(df, doc_id, text))


def _groups(keys: DataFrame) -> DataFrame:
    per = keys.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d"))
    return per.groupBy("look").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_docs"), F.min("d").alias("first_doc"))


def look_alike_members(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, look, first_doc, n_texts, n_docs: each document with a visible character, the class of those that look like it, and how many strings and documents the class has.

    Exact copies keep their own rows and aren't paired. Only digests and counts are shuffled; classes are joined back by
    shuffle, a class that holds many rows by broadcast of the few classes above a bound.
    """
    keys = cut(skeleton_keys(df, doc_id, text), "looks")
    groups = cut(_groups(keys), "groups")
    hot = F.broadcast(groups.filter(F.col("n_docs") > HOT_CLASS))
    some = keys.select("doc_id", "look").join(hot, "look")
    rest = keys.select("doc_id", "look").join(hot.select("look"), "look", "left_anti").join(groups, "look")
    return some.unionByName(rest)


def look_alike_pairs(keys: DataFrame) -> DataFrame:
    """doc_id_1, doc_id_2 (smaller first): documents that look the same but are stored as different strings.

    keys: skeleton_keys(). Groups with one string, however many exact copies it has, leave first, by a map-side min and
    max; pairs are then formed between distinct strings of a group, and only those pairs are expanded to their documents,
    so exact copies never meet each other and no group is gathered in a task. Repeated rows count once; rows without a
    doc_id can't be named and form no pair; empty tables give an empty result. The digests are written once, so texts are
    read once.
    """
    keys = cut(keys, "looks")
    mixed = keys.groupBy("look").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).filter("a <> b").select("look")
    mixed = F.broadcast(mixed) if small(mixed, BROADCAST_ROWS) else mixed
    members = keys.filter("doc_id is not null").join(mixed, "look", "left_semi").distinct()
    texts = members.select("look", "exact").distinct()
    two = texts.select("look", F.col("exact").alias("e1")).join(texts.select("look", F.col("exact").alias("e2")), "look").filter("e1 < e2")
    one = members.select("look", F.col("exact").alias("e1"), F.col("doc_id").alias("d1"))
    other = members.select("look", F.col("exact").alias("e2"), F.col("doc_id").alias("d2"))
    pairs = two.join(one, ["look", "e1"]).join(other, ["look", "e2"]).filter("d1 <> d2")
    return pairs.select(F.least("d1", "d2").alias("doc_id_1"), F.greatest("d1", "d2").alias("doc_id_2")).distinct()
