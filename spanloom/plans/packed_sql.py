"""The SQL of p2_found and p2_delimiters."""

_SEPARATORS, _PRIVATE = "|;,/¦ ", "".join(chr(0xE000 + i) for i in range(6))

#: The field without its enclosing quotes; then what stands in quotes gets private characters for separators, so that every
#: separator left before an item start is a cut.
_ITEMS = r"""(SELECT word_id, '{field}' AS field, list_filter(list_transform(string_split(regexp_replace(j, '[\s|;,/¦]+({start})', chr(1) || '\1', 'g'), chr(1)),
lambda x: translate(regexp_replace(regexp_replace(x, '[\s|;,/¦]+$', ''), '^[\s|;,/¦]+', ''), '{private}', '{separators}')), lambda x: regexp_matches(x, '^{start}')) AS items
FROM (SELECT word_id, array_to_string(list_transform(string_split(replace(s, '''', '"'), '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, '{separators}', '{private}') ELSE x END), '') AS j
FROM (SELECT word_id, CASE WHEN regexp_full_match(t, '"([^"]|"")*"') AND length(t) > 1 THEN replace(t[2:length(t) - 1], '""', '"') WHEN regexp_full_match(t, '''([^'']|'''')*''') AND length(t) > 1 THEN replace(t[2:length(t) - 1], '''''', '''') ELSE t END AS s
FROM (SELECT word_id, trim({field}) AS t FROM cur) WHERE t IS NOT NULL AND t NOT IN ('', '_'))))"""


def _items(field: str, start: str) -> str:
    return _ITEMS.format(field=field, start=start, separators=_SEPARATORS, private=_PRIVATE)


_FEAT, _DEP = r"\p{Lu}[\p{L}\p{N}]*(?:\[[\p{L}\p{N}]+\])?=", r"[0-9]+(?:\.[0-9]+)?:"

P2_FOUND = f"""WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM conllu) WHERE rn = 1),
x AS (SELECT * FROM {_items("feats", _FEAT)} UNION ALL SELECT * FROM {_items("deps", _DEP)})
SELECT word_id, field, CAST(generate_subscripts(items, 1) AS INTEGER) AS pos, unnest(items) AS item FROM x"""

_BARE = r"""SELECT treebank AS source, '{field}' AS field, CASE WHEN regexp_matches(t, '["'']') THEN regexp_replace(t, '(^|[=:\s|;,/¦])("[^"]*"|''[^'']*'')', '\1Q', 'g') ELSE t END AS bare
FROM (SELECT treebank, CASE WHEN regexp_full_match(t, '"([^"]|"")*"') AND length(t) > 1 THEN replace(t[2:length(t) - 1], '""', '"') WHEN regexp_full_match(t, '''([^'']|'''')*''') AND length(t) > 1 THEN replace(t[2:length(t) - 1], '''''', '''') ELSE t END AS t
FROM (SELECT treebank, trim({field}) AS t FROM conllu WHERE {field} IS NOT NULL AND {field} NOT IN ('', '_')))"""

#: The scores from the counts of layouts, with the prior pieces and the bar of the operator.
P2_DELIMITERS = rf"""WITH b AS ({_BARE.format(field="feats")} UNION ALL {_BARE.format(field="deps")}),
l AS (SELECT source, field, CASE WHEN field = 'feats' THEN regexp_extract_all(bare, '([|;,/¦\s]+)(?:Q|["'']?{_FEAT})', 1) ELSE regexp_extract_all(bare, '([|;,/¦\s]+)(?:Q|["'']?{_DEP})', 1) END AS cuts, regexp_extract_all(bare, '[|;,/¦\s]+') AS plain FROM b),
d(delimiter, p) AS (VALUES ('bar', '\s*(\|\s*)+'), ('semicolon', '\s*(;\s*)+'), ('comma', '\s*(,\s*)+'), ('slash', '\s*(/\s*)+'), ('broken_bar', '\s*(¦\s*)+'), ('blank', '\s+')),
m AS (SELECT source, field, delimiter, len(cuts) AS n, len(list_filter(cuts, lambda x: regexp_full_match(x, p))) AS made, len(list_filter(plain, lambda x: regexp_full_match(x, p))) AS there FROM l, d),
c AS (SELECT source, field, delimiter, CAST(sum(made) AS BIGINT) AS cuts, CAST(sum(there) AS BIGINT) AS plain, count(*) FILTER (n > 0 AND made = n) AS alone, count(*) FILTER (n > 0) AS several FROM m GROUP BY ALL),
g AS (SELECT field, delimiter, sum(cuts) / (sum(plain) + 10) AS pr, coalesce(sum(alone) / nullif(sum(several), 0), 0) AS pc FROM c GROUP BY ALL),
s AS (SELECT *, least(1.0, (cuts + 50 * pr) / (plain + 50)) * ((alone + 50 * pc) / (several + 50)) AS score FROM c JOIN g USING (field, delimiter))
SELECT source, field, delimiter, cuts, plain, alone, several, round(CASE WHEN plain > 0 THEN least(1.0, cuts / plain) ELSE 0.0 END, 8) AS regularity, round(CASE WHEN several > 0 THEN alone / several ELSE 0.0 END, 8) AS consistency,
round(score, 8) AS score, score >= 0.003 AS chosen FROM s"""
