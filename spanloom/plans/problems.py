"""Queries of the general data problems (2, 4, 5, 6) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import hierarchy, packed, rejects, wide
from spanloom.plans.packed_sql import P2_DELIMITERS, P2_FOUND
from spanloom.tables import PLAIN_NUMBER, current_rows, current_words, read

PACKED = {"feats": packed.FEATURE, "deps": packed.DEPENDENCY}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    conllu = read(spark, d, "conllu")
    words = current_words(conllu, ["treebank", "feats", "deps"])
    return packed.split_packed(words, ["word_id"], "treebank", PACKED, scored=conllu)


def p2_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every candidate, and which reach the bar; those are the separators p2_found cuts by."""
    s = packed.delimiter_scores(read(spark, d, "conllu"), "treebank", PACKED)
    return s.withColumns({c: F.round(c, 8) for c in ("regularity", "consistency", "score")} | {"chosen": F.col("score") >= packed.LEAST_SCORE})


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.pivot_typed(read(spark, d, "conllu_feats"), read(spark, d, "feat_inventory"), "word_id", "attr", "val", ["loaded_at", "row_no"])


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed column per attribute; whole numbers of any length as text, the unread values as `attr=val` joined by semicolons."""
    w = _wide(spark, d)
    unread = F.array_join(F.transform(F.map_entries("unread"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return w.withColumns({"unread": unread, "numvalue": F.col("cells")["NumValue"], "person": F.col("cells")["Person"]}).drop("cells")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.cells_of(_wide(spark, d), "word_id")


def p4_failures(spark: SparkSession, d: str) -> DataFrame:
    return wide.failures(read(spark, d, "conllu_feats"), read(spark, d, "feat_inventory")).select("row_no", "word_id", "attr", "val", "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.faulty_lines(read(spark, d, "conllu_lines"))


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "conllu_lines")
    return rejects.valid_rows(lines, rejects.faulty_lines(lines), extra=("file_name", "line_no"))


def constituent_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of constituents as nodes: a negative parent marks a root, a negative link none."""
    rows = current_rows(read(spark, d, "constituents"), ["parse_id", "cons"], ["loaded_at"], ["parent", "left_child", "right_sib"])
    link = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return rows.select(F.col("parse_id").alias("tree"), F.col("cons").alias("node"), link("parent"), (F.col("parent") < 0).alias("is_root"), link("left_child"), link("right_sib"))


def word_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Current plain-number words as nodes of their sentence; HEAD 0 marks a root."""
    rows = current_words(read(spark, d, "conllu"), ["sent_id", "id", "head"]).filter(F.col("id").rlike(PLAIN_NUMBER))
    head = F.when(F.col("head").rlike(PLAIN_NUMBER), F.col("head").try_cast("bigint"))
    return rows.select(F.col("sent_id").alias("tree"), F.col("id").try_cast("bigint").alias("node"), head.alias("parent"), (head == 0).alias("is_root"))


TREES = (("constituents", constituent_nodes), ("conllu", word_nodes))


def p6_hierarchies(spark: SparkSession, d: str) -> DataFrame:
    parts = [hierarchy.with_verdict(hierarchy.hierarchy(f(spark, d))).withColumn("source", F.lit(name)) for name, f in TREES]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_hierarchies(spark, d).select("source", F.col("tree").alias("tree_id"), "node", "path")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    parts = [hierarchy.descendants(f(spark, d)).withColumn("source", F.lit(name)) for name, f in TREES]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p2_found, p2_delimiters, p4_found, p4_wide, p4_failures, p5_found, p5_valid, p6_found, p6_hierarchies, p6_descendants)}
#: Each row with the attribute (a) and the value (v) read from it. A listed whole number is its digits or a long name.
_READ = """WITH inv AS (SELECT attr, val_type, val, long_name FROM feat_inventory WHERE attr IS NOT NULL),
nk AS (SELECT DISTINCT regexp_replace(lower(attr), '[^a-z0-9]', '', 'g') AS k, attr, val_type FROM inv),
ln AS (SELECT attr, val, regexp_replace(lower(long_name), '[^a-z0-9]', '', 'g') AS k FROM inv WHERE val IS NOT NULL),
vk AS (SELECT attr, val, regexp_replace(lower(val), '[^a-z0-9]', '', 'g') AS k FROM inv WHERE val IS NOT NULL UNION SELECT * FROM ln),
free AS (SELECT attr FROM inv GROUP BY 1 HAVING count(val) = 0),
f AS (SELECT *, regexp_replace(lower(regexp_replace(trim(attr), '^([A-Za-z0-9_-]+[.:]+)+([A-Za-z0-9])', '\\2')), '[^a-z0-9]', '', 'g') AS ak, regexp_replace(lower(regexp_replace(trim(val), '^([A-Za-z0-9_-]+[.:]+)+([A-Za-z0-9])', '\\2')), '[^a-z0-9]', '', 'g') AS k,
CASE WHEN regexp_full_match(trim(val), '\\+?[0-9]+(\\.0*)?') THEN regexp_replace(regexp_extract(trim(val), '[0-9]+'), '^0+([0-9])', '\\1') END AS num FROM conllu_feats),
r AS (SELECT f.*, nk.attr AS a, nk.val_type AS vt FROM f LEFT JOIN nk ON nk.k = f.ak),
x AS (SELECT r.row_no, r.word_id, r.attr, r.val, r.a, r.loaded_at, CASE vt WHEN 'category' THEN vk.val
WHEN 'flag' THEN CASE WHEN trim(lower(r.val)) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true' WHEN trim(lower(r.val)) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
WHEN 'whole' THEN CASE WHEN r.a IN (SELECT attr FROM free) THEN num WHEN num IS NOT NULL THEN (SELECT max(val) FROM inv i WHERE i.attr = r.a AND i.val = num) WHEN NOT regexp_matches(r.val, '[0-9]') THEN (SELECT max(val) FROM ln WHERE ln.attr = r.a AND ln.k = r.k) END END AS v
FROM r LEFT JOIN vk ON vk.attr = r.a AND vk.k = r.k AND r.vt = 'category')
"""

#: The nodes of both sources (n), the paths from roots (p) and the nodes whose way up ends nowhere (d).
TREES_SQL = """WITH RECURSIVE cn AS (SELECT parse_id, cons, parent, left_child, right_sib FROM (SELECT *, row_number() OVER (PARTITION BY parse_id, cons ORDER BY loaded_at DESC NULLS LAST) AS rn FROM constituents) WHERE rn = 1),
own AS (SELECT parse_id, left_child AS cons, min(cons) AS q FROM cn WHERE left_child >= 0 GROUP BY 1, 2),
lead AS (SELECT parse_id, cons, q, 0 AS hop FROM own UNION ALL SELECT l.parse_id, c.right_sib, q, hop + 1 FROM lead l JOIN cn c ON c.parse_id = l.parse_id AND c.cons = l.cons WHERE c.right_sib >= 0 AND hop < 200),
led AS (SELECT parse_id, cons, arg_min(q, hop * 100000 + q) AS q FROM lead GROUP BY 1, 2),
cw AS (SELECT sent_id, TRY_CAST(id AS BIGINT) AS node, head FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM conllu) WHERE rn = 1 AND regexp_full_match(id, '[0-9]+')),
n AS (SELECT 'constituents' AS source, cn.parse_id AS tree_id, cn.cons::BIGINT AS node, CASE WHEN parent >= 0 THEN parent WHEN parent IS NULL THEN q END::BIGINT AS up, parent < 0 OR (parent IS NULL AND q IS NULL) AS is_root FROM cn LEFT JOIN led USING (parse_id, cons)
UNION ALL SELECT 'conllu', sent_id, node, CASE WHEN regexp_full_match(head, '[0-9]+') THEN TRY_CAST(head AS BIGINT) END, coalesce(regexp_full_match(head, '[0-9]+') AND TRY_CAST(head AS BIGINT) = 0, false) FROM cw WHERE node IS NOT NULL),
p AS (SELECT source, tree_id, node, node::VARCHAR AS path FROM n WHERE is_root UNION ALL SELECT n.source, n.tree_id, n.node, p.path || '/' || n.node FROM p JOIN n ON n.source = p.source AND n.tree_id = p.tree_id AND n.up = p.node AND NOT coalesce(n.is_root, false)),
d AS (SELECT n.source, n.tree_id, n.node FROM n LEFT JOIN n m ON m.source = n.source AND m.tree_id = n.tree_id AND m.node = n.up WHERE NOT coalesce(n.is_root, false) AND m.node IS NULL UNION ALL SELECT n.source, n.tree_id, n.node FROM d JOIN n ON n.source = d.source AND n.tree_id = d.tree_id AND n.up = d.node AND NOT coalesce(n.is_root, false))"""

#: The nodes that aren't on a cycle (f), and each of their descendants (below).
_FOREST = """, reach AS (SELECT source, tree_id, node, up AS anc FROM n WHERE up IS NOT NULL AND NOT coalesce(is_root, false) UNION SELECT r.source, r.tree_id, r.node, m.up FROM reach r JOIN n m ON m.source = r.source AND m.tree_id = r.tree_id AND m.node = r.anc WHERE m.up IS NOT NULL AND NOT coalesce(m.is_root, false)),
ring AS (SELECT source, tree_id, node FROM reach WHERE node = anc),
f AS (SELECT n.source, n.tree_id, n.node, CASE WHEN NOT coalesce(n.is_root, false) THEN n.up END AS up FROM n ANTI JOIN ring USING (source, tree_id, node)),
below AS (SELECT f.source, f.tree_id, f.node, f.up AS anc, 1 AS distance FROM f JOIN f g ON g.source = f.source AND g.tree_id = f.tree_id AND g.node = f.up UNION ALL SELECT b.source, b.tree_id, b.node, g.up, distance + 1 FROM below b JOIN f g ON g.source = b.source AND g.tree_id = b.tree_id AND g.node = b.anc JOIN f h ON h.source = g.source AND h.tree_id = g.tree_id AND h.node = g.up)"""

_PAIR = "\\p{Lu}[\\p{L}\\p{N}]*(\\[[\\p{L}\\p{N}]+\\])?=[A-Z0-9][A-Za-z0-9]*(,[A-Z0-9][A-Za-z0-9]*)*"

#: Each line that is a case, its cells and the first reason against it.
_FAULTS = f"""l AS (SELECT line_id, regexp_replace(regexp_replace(line, '^' || chr(65279), ''), chr(13) || '$', '') AS t FROM conllu_lines WHERE line IS NOT NULL),
f AS (SELECT line_id, string_split(t, chr(9)) AS c FROM l WHERE NOT starts_with(t, '#') AND NOT regexp_full_match(t, '[ \\t\\n\\r\\f\\x0B]*')),
g AS (SELECT line_id, c, len(c) AS n, c[1] AS id, c[6] AS feats, c[7] AS head, length(c[6]) - length(replace(c[6], '"', '')) AS q FROM f),
h AS (SELECT *, q = 2 AND length(feats) >= 2 AND starts_with(feats, '"') AND ends_with(feats, '"') AS around FROM g),
k AS (SELECT *, CASE WHEN around THEN feats[2:length(feats) - 1] ELSE feats END AS bare FROM h),
r AS (SELECT line_id, c, bare, CASE WHEN n <> 10 THEN 'columns' WHEN q > 0 AND NOT around THEN 'quoting'
WHEN NOT (regexp_full_match(id, '[1-9][0-9]*') OR regexp_full_match(id, '(0|[1-9][0-9]*)\\.[1-9][0-9]*') OR (regexp_full_match(id, '[1-9][0-9]*-[1-9][0-9]*') AND TRY_CAST(split_part(id, '-', 1) AS HUGEINT) < TRY_CAST(split_part(id, '-', 2) AS HUGEINT))) THEN 'id'
WHEN regexp_full_match(id, '[1-9][0-9]*') AND (NOT regexp_full_match(head, '0|[1-9][0-9]*') OR head = id) THEN 'head' WHEN NOT regexp_full_match(id, '[1-9][0-9]*') AND head <> '_' THEN 'head'
WHEN bare <> '_' AND (NOT regexp_full_match(bare, '{_PAIR}(\\|{_PAIR})*') OR len(list_distinct([split_part(x, '=', 1) for x in string_split(bare, '|')])) <> len(string_split(bare, '|'))) THEN 'feats' END AS reason FROM k)"""

SQL = {
    "p2_found": P2_FOUND,
    "p2_delimiters": P2_DELIMITERS,
    "p4_found": _READ + """SELECT word_id, a AS attr, v AS val FROM (SELECT *, row_number() OVER (PARTITION BY word_id, a ORDER BY loaded_at DESC NULLS LAST, row_no DESC) AS rn FROM x WHERE v IS NOT NULL AND word_id IS NOT NULL) WHERE rn = 1""",
    "p4_wide": _READ + """, got AS (SELECT word_id, a, v FROM (SELECT *, row_number() OVER (PARTITION BY word_id, a ORDER BY loaded_at DESC NULLS LAST, row_no DESC) AS rn FROM x WHERE v IS NOT NULL AND word_id IS NOT NULL) WHERE rn = 1),
bad AS (SELECT word_id, a, val FROM (SELECT *, row_number() OVER (PARTITION BY word_id, a ORDER BY loaded_at DESC NULLS LAST, row_no DESC) AS rn FROM x WHERE v IS NULL AND val IS NOT NULL AND a IS NOT NULL AND word_id IS NOT NULL) WHERE rn = 1 AND (word_id, a) NOT IN (SELECT (word_id, a) FROM got)),
u AS (SELECT word_id, string_agg(a || '=' || val, ';' ORDER BY a) AS unread FROM bad GROUP BY 1),
ids AS (SELECT word_id FROM got UNION SELECT word_id FROM bad)
SELECT word_id, max(v) FILTER (a = 'Case') AS "case", max(v) FILTER (a = 'Definite') AS definite, max(v) FILTER (a = 'Degree') AS degree, max(v) FILTER (a = 'Foreign') = 'true' AS "foreign",
max(v) FILTER (a = 'Gender') AS gender, max(v) FILTER (a = 'Mood') AS mood, max(v) FILTER (a = 'NumValue') AS numvalue, max(v) FILTER (a = 'Number') AS number, max(v) FILTER (a = 'Number[psor]') AS number_psor,
max(v) FILTER (a = 'Person') AS person, max(v) FILTER (a = 'Poss') = 'true' AS poss, max(v) FILTER (a = 'PronType') AS prontype, max(v) FILTER (a = 'Reflex') = 'true' AS reflex, max(v) FILTER (a = 'Tense') AS tense,
max(v) FILTER (a = 'Typo') = 'true' AS typo, max(v) FILTER (a = 'VerbForm') AS verbform, coalesce(any_value(unread), '') AS unread
FROM ids LEFT JOIN got USING (word_id) LEFT JOIN u USING (word_id) GROUP BY 1""",
    "p4_failures": _READ + """SELECT row_no, word_id, attr, val, CASE WHEN trim(coalesce(attr, '')) = '' THEN 'no name' WHEN a IS NULL THEN 'unknown attribute' WHEN trim(coalesce(val, '')) = '' THEN 'no value' ELSE 'unreadable value' END AS reason FROM x WHERE v IS NULL""",
    "p5_found": f"""WITH {_FAULTS}
SELECT line_id, reason FROM r WHERE reason IS NOT NULL""",
    "p5_valid": f"""WITH {_FAULTS}
SELECT line_id, file_name, line_no, c[1] AS id, c[2] AS form, c[3] AS lemma, c[4] AS upos, c[5] AS xpos, bare AS feats, c[7] AS head, c[8] AS deprel, c[9] AS deps, c[10] AS misc FROM r JOIN (SELECT line_id, file_name, line_no FROM conllu_lines) USING (line_id) WHERE reason IS NULL""",
    "p6_found": TREES_SQL + """
SELECT n.source, n.tree_id, n.node, coalesce(p.path, CASE WHEN d.node IS NOT NULL THEN 'dangling' ELSE 'cycle' END) AS path FROM n LEFT JOIN p USING (source, tree_id, node) LEFT JOIN d USING (source, tree_id, node)""",
    "p6_hierarchies": TREES_SQL + _FOREST + """
SELECT n.source, n.tree_id AS tree, n.node, CASE WHEN p.path IS NOT NULL THEN 'tree' WHEN d.node IS NOT NULL THEN 'dangling' ELSE 'cycle' END AS state, coalesce(p.path, CASE WHEN d.node IS NOT NULL THEN 'dangling' ELSE 'cycle' END) AS path,
CAST(CASE WHEN p.path IS NOT NULL THEN len(string_split(p.path, '/')) - 1 END AS INTEGER) AS depth, CAST(split_part(p.path, '/', 1) AS BIGINT) AS root, CASE WHEN f.node IS NOT NULL THEN 1 + coalesce(c.n, 0) END AS subtree_size
FROM n LEFT JOIN p USING (source, tree_id, node) LEFT JOIN d USING (source, tree_id, node) LEFT JOIN f USING (source, tree_id, node) LEFT JOIN (SELECT source, tree_id, anc AS node, count(*) AS n FROM below GROUP BY ALL) c USING (source, tree_id, node)""",
    "p6_descendants": TREES_SQL + _FOREST + """
SELECT source, tree_id AS tree, anc AS node, node AS descendant, distance FROM below""",
}
