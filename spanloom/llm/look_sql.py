"""The SQL of problems 8 and 9: one form for all texts, by translation of single characters."""

from __future__ import annotations

import unicodedata

from spanloom.llm.skeleton import skeleton

#: The blocks whose characters are put through the fixed values and rules, so that composed letters are covered as well.
_BLOCKS = (range(0x01, 0x20), range(0x7F, 0xA1), range(0xAD, 0xAE), range(0x250, 0x2B0), range(0x370, 0x530), range(0x2000, 0x2070), range(0x3000, 0x3001), range(0xFE00, 0xFE10), range(0xFEFF, 0xFF00), range(0xFF10, 0xFF60))
_LIGATURES = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ")


def _translation() -> tuple[str, str]:
    put, gone, to = "", "", ""
    for code in (c for b in _BLOCKS for c in b):
        ch = chr(code)
        out = unicodedata.normalize("NFC", skeleton(ch))
        if out == "":
            gone += ch
        elif out != ch and len(out) == 1:
            put, to = put + ch, to + out
    return put + gone, to


def look(column: str) -> str:
    """SQL for the form that texts of equal look share."""
    text = f"nfc_normalize({column})"
    for x in _LIGATURES:
        text = f"replace({text}, '{x}', '{unicodedata.normalize('NFKD', x)}')"
    before, after = (s.replace("'", "''") for s in _translation())
    return f"nfc_normalize(translate({text}, '{before}', '{after}'))"


_LOOKS = f"WITH s AS (SELECT doc_id, text, {look('text')} AS look FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM s WHERE regexp_matches(look, '[^ \\t\\n\\r]'))"
_CLASSES = f"{_LOOKS}, g AS (SELECT look, count(DISTINCT text) AS n_texts, count(*) AS n_docs, min(doc_id) AS first_doc FROM v GROUP BY 1)"
_WORDS = r"regexp_extract_all(lower(t), '(?:[\p{L}\p{N}][\x{300}-\x{36f}]*)+')"
_RUNS = "unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))"

SQL = {
    "p9_found": f"{_LOOKS} SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM v a JOIN v b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_groups": f"{_CLASSES} SELECT first_doc, n_texts, n_docs FROM g",
    "p9_members": f"{_CLASSES} SELECT doc_id, first_doc AS class_id, n_texts, n_docs FROM v JOIN g USING (look)",
    "p8_found": rf"""WITH d AS (SELECT doc_id, kind, {look('text')} AS s FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {look('text')} AS s FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT doc_id, CASE kind WHEN 'tagged' THEN regexp_replace(s, '/[^\s/]+(\s|$)', ' \1', 'g') WHEN 'bracket' THEN regexp_replace(s, '\([^\s()]+', ' ', 'g')
WHEN 'columns' THEN array_to_string(list_transform(string_split(s, chr(10)), lambda x: CASE WHEN len(string_split(x, chr(9))) > 2 THEN string_split(x, chr(9))[2] ELSE x END), chr(10))
ELSE regexp_replace(s, '([\p{{L}}\p{{N}}])-[ \t]*\r?\n[ \t]*([\p{{L}}\p{{N}}])', '\1\2', 'g') END AS t FROM d),
dw AS (SELECT doc_id, {_WORDS} AS w FROM t), iw AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, regexp_replace(s, '([\p{{L}}\p{{N}}])-[ \t]*\r?\n[ \t]*([\p{{L}}\p{{N}}])', '\1\2', 'g') AS t FROM i)),
dr AS (SELECT DISTINCT doc_id, {_RUNS} AS run FROM dw), ir AS (SELECT DISTINCT item_id, {_RUNS} AS run FROM iw)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)""",
}
