"""Evaluation texts leaking into training text: pigeonhole pieces, exact hits, bit-parallel verification."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.skeleton import _TABLE, FORMS, look_alike_table, skeleton
from spanloom.session import cut

#: Items are held by every task if their texts have at most so many characters; beyond that pieces meet documents in a join.
HELD_CHARACTERS = 16_000_000

_WORDS = re.compile(r"(?:[^\W_][̀-ͯ]*)+")
_CUT = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n[ \t]*(?=[^\W_])")
_TAG = re.compile(r"/[^\s/]+(?=\s|$)")
_LABEL = re.compile(r"\([^\s()]+(?=[\s()]|$)")


_MARKS = re.compile("[̀-ͯ]")
_LATIN = re.compile("[A-Za-z]")


class _Keys(dict):
    """What a word that isn't ASCII is compared by: its skeleton in one case, filled as words are met; emptied at KEPT_WORDS, as it is only a memory.

    Case and look don't agree on letters of other scripts: Cyrillic Ve looks like a B, its small form like nothing in Latin.
    A word that can be read as Latin, as it stands or in capitals, is compared as that; any other word is put into
    lower case before its skeleton is taken.
    """

    KEPT_WORDS = 100_000

    def __init__(self, table: dict[int, str]):
        super().__init__()
        self.table = table

    def __reduce__(self):
        return _Keys, (self.table,)

    def __missing__(self, w: str) -> str:
        if len(self) >= self.KEPT_WORDS:
            self.clear()
        upper = w.upper()
        readings = [w] if _LATIN.search(w) else []
        readings += [upper] if len(upper) == len(w) else []
        for r in readings:
            key = skeleton(r, self.table).lower()
            if _MARKS.sub("", key).isascii():
                break
        else:
            key = skeleton(w.lower(), self.table)
        self[w] = key = unicodedata.normalize("NFC", key)
        return key


def words(text: str | None, kind: str | None = None, keys: _Keys | None = None) -> list[str]:
    """The words that are compared: runs of letters and digits of the skeleton (keys, from look_alike_table), in one case.

    In annotated kinds tags (`word/TAG`), labels (`(TAG word)`) and the other columns (number, word, ...) are left out; in
    other kinds a word cut by a hyphen at a line end is put together.
    """
    if not text:
        return []
    s = unicodedata.normalize("NFC", skeleton(text, FORMS))
    if kind == "tagged":
        s = _TAG.sub(" ", s)
    elif kind == "bracket":
        s = _LABEL.sub(" ", s)
    elif kind == "columns":
        s = "\n".join(f[1] if len(f := line.split("\t")) > 2 else line for line in s.split("\n"))
    elif "-" in s:
        s = _CUT.sub("", s)
    if s.isascii():
        return _WORDS.findall(s.lower())
    keys = _DEFAULT if keys is None else keys
    return [w.lower() if w.isascii() else keys[w] for w in _WORDS.findall(s)]


_DEFAULT = _Keys(_TABLE)


def piece_length(run: int, errors: int) -> int:
    """Pieces so short that any `run` words of an item hold errors + 1 whole pieces: then one of them has no error."""
    return max(1, (run + 1) // (errors + 2))


def myers_distance(pattern: Sequence[str], text: Sequence[str]) -> int:
    """The least edit distance between the pattern and any stretch of the text, bit-parallel over the pattern's words."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = where.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diag | plus) & full, plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(diag | up) & full, up & diag
        best = min(best, score)
    return best


class _Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, errors: int):
        self.items, self.run, self.errors, self.q = items, run, errors, piece_length(run, errors)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ws) in enumerate(items):
            if len(ws) >= run:
                for a in range(0, len(ws) - self.q + 1, self.q):
                    places[" ".join(ws[a : a + self.q])].append((k, a))
        self.auto = ahocorasick.Automaton()
        for piece, at in places.items():
            self.auto.add_word(f" {piece} ", at)
        self.any = bool(places)
        if self.any:
            self.auto.make_automaton()

    def search(self, ws: list[str]) -> dict[int, int]:
        """Item position -> least distance of a passage, for the items with one within the error budget."""
        found: dict[int, int] = {}
        if not self.any or len(ws) < self.q:
            return found
        line = f" {' '.join(ws)} "
        for end, at in self.auto.iter(line):
            w = line.count(" ", 0, end) - self.q  # the doc word where the piece begins
            for k, a in at:
                if found.get(k, 1) == 0:
                    continue
                d = self._verify(ws, w, self.items[k][1], a)
                if d <= self.errors and d < found.get(k, self.errors + 1):
                    found[k] = d
        return found

    def _verify(self, ws: list[str], w: int, item: list[str], a: int) -> int:
        best = self.errors + 1
        for s in range(max(0, a + self.q - self.run), min(a, len(item) - self.run) + 1):
            lo, hi = w - (a - s) - self.errors, w - (a - s) + self.run + self.errors
            if hi < self.run - self.errors:
                continue
            best = min(best, myers_distance(item[s : s + self.run], ws[max(0, lo) : hi]))
            if not best:
                break
        return best


def leaks(docs: DataFrame, items: DataFrame, run: int = 8, errors: int = 0, doc_id: str = "doc_id", text: str = "text", kind: str | None = "kind", item_id: str = "item_id", item_text: str = "text", held_characters: int = HELD_CHARACTERS) -> DataFrame:
    """doc_id, item_id, distance: documents that hold `run` consecutive words of an item within `errors` word edits.

    Every item is split into pieces such that any `run` words hold errors + 1 whole ones; exact hits of the pieces in a
    document's words are found, and each hit is verified by Myers' bit-parallel distance between the item's windows around
    the piece and the document's words there. Documents are read once.

    Items of at most held_characters in all (their sum is checked first) are held by every task: an automaton finds the
    hits of all pieces in one pass, and documents are never shuffled. Larger item sets stay distributed: the words of
    documents and items are written, their pieces meet in a join by hash, and the hits are joined with both to be verified;
    the result is the same. One row per document and item; null and empty texts have no words; items with fewer than `run`
    words never match; rows with a null item_id are no items; repeated items and documents give one row per pair.
    """
    keys = _Keys(look_alike_table(docs.sparkSession))
    spec = cut(items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct(), "items")
    has_kind = kind is not None and kind in docs.columns
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (F.col(kind) if has_kind else F.lit(None).cast("string")).alias("kind")).filter("text is not null")
    size = spec.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).head()[0]
    if size > held_characters:
        return _leaks_by_join(src, spec, run, errors, keys)
    held = [(r["i"], words(r["t"], None, keys)) for r in spec.collect()]  # at most held_characters

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(held, run, errors)
        for batch in batches:
            ds, its, dist = [], [], []
            for d, t, k in zip(*[c.to_pylist() for c in batch.columns]):
                for i, e in matcher.search(words(t, k, keys)).items():
                    ds.append(d), its.append(held[i][0]), dist.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(its, pa.int64()), pa.array(dist, pa.int32())], names=["doc_id", "item_id", "distance"])

    return src.mapInArrow(search, "doc_id bigint, item_id bigint, distance int").groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _leaks_by_join(src: DataFrame, spec: DataFrame, run: int, errors: int, keys: _Keys) -> DataFrame:
    """The same for item sets that no task can hold. Pieces are known by 64 bits; a false hit doesn't pass the verification.

    An item is taken apart into stretches of a piece with the windows around it, so what a hit carries is bounded by `run`,
    not by the item. A piece that stands in a great many documents is one of the join's hot keys, which AQE splits, as the
    items' side of a piece has one row per place in an item.
    """
    q = piece_length(run, errors)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(*[c.to_pylist() for c in batch.columns]):
                ws = words(t, None, keys)
                if len(ws) >= run:
                    for a in range(0, len(ws) - q + 1, q):
                        lo = max(0, a + q - run)
                        out.append((i, " ".join(ws[a : a + q]), a - lo, ws[lo : a + run]))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "piece", "at", "around"), r)) for r in out], schema=pa.schema([("item_id", pa.int64()), ("piece", pa.string()), ("at", pa.int32()), ("around", pa.list_(pa.string()))]))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece of each document with the words around it that a window with errors may take."""
        reach = run - q + errors
        for batch in batches:
            out = []
            for d, t, k in zip(*[c.to_pylist() for c in batch.columns]):
                ws = words(t, k, keys)
                for w in range(len(ws) - q + 1):
                    lo = max(0, w - reach)
                    out.append((d, " ".join(ws[w : w + q]), w - lo, ws[lo : w + q + reach]))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "piece", "w", "near"), r)) for r in out], schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.string()), ("w", pa.int32()), ("near", pa.list_(pa.string()))]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for d, i, at, around, w, near in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "at", "around", "w", "near")]):
                best = errors + 1
                for s in range(max(0, at + q - run), min(at, len(around) - run) + 1):
                    lo, hi = w - (at - s) - errors, w - (at - s) + run + errors
                    if hi >= run - errors:
                        best = min(best, myers_distance(around[s : s + run], near[max(0, lo) : hi]))
                if best <= errors:
                    kept.append((d, i, best))
            cols = list(zip(*kept)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "distance"])

    pieces = cut(spec.mapInArrow(stretches, "item_id bigint, piece string, at int, around array<string>").withColumn("h", F.xxhash64("piece")).drop("piece"), "pieces")
    places = src.mapInArrow(grams, "doc_id bigint, piece string, w int, near array<string>").withColumn("h", F.xxhash64("piece")).drop("piece")
    hits = places.join(pieces, "h").select("doc_id", "item_id", "at", "around", "w", "near")
    return hits.mapInArrow(verify, "doc_id bigint, item_id bigint, distance int").groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
