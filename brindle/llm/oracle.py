"""What SQL can express of the queries, for DuckDB over the same tables."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_METRICS = {"symbols": False, "word_length": True, "dup_lines": False, "repeats": False}
# Own values in ten thousandths, and fifty values dealt as those of the language, which itself has fifty as those of the table.
_EDGE = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
_WIDTH = "(1 << greatest(length(bin({0})) - 6, 0))"
_LEVELS = f"""
groups AS (SELECT DISTINCT lang, source FROM stats),
h_all AS (SELECT metric, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY metric) AS total FROM hist GROUP BY metric, bucket),
h_lang AS (SELECT lang, metric, bucket, sum(n)::HUGEINT AS n FROM (SELECT lang, metric, bucket, 10000 * n AS n FROM hist
  UNION ALL SELECT lang, metric, bucket, (500000::HUGEINT * n) // total FROM (SELECT DISTINCT lang FROM groups) CROSS JOIN h_all) GROUP BY ALL),
t_lang AS (SELECT *, sum(n) OVER (PARTITION BY lang, metric) AS total FROM h_lang),
h_own AS (SELECT lang, source, metric, bucket, sum(n)::HUGEINT AS n FROM (SELECT lang, source, metric, bucket, 10000 * n AS n FROM hist
  UNION ALL SELECT lang, source, metric, bucket, (500000::HUGEINT * n) // total FROM groups JOIN t_lang USING (lang)) GROUP BY ALL),
c_own AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM h_own),
q_own AS (SELECT lang, source, metric, min(bucket) FILTER (10 * seen >= total) AS ql, min(bucket) FILTER (2 * seen >= total) AS qm, min(bucket) FILTER (10 * seen >= 9 * total) AS qh
  FROM c_own GROUP BY lang, source, metric),
f_own AS (SELECT lang, source, metric, least(qm - 4 * (qm - ql), ql - {_WIDTH.format('ql')}) AS low, greatest(qm + 4 * (qh - qm), qh + {_WIDTH.format('qh')}) AS high FROM q_own),"""
_OUT = " OR ".join([f"{_EDGE.format(m)} > high_{m}" for m in _METRICS] + [f"{_EDGE.format('word_length')} < low_word_length"])
OP3 = rf"""
WITH base AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM wins SEMI JOIN (SELECT doc_id, g FROM wins GROUP BY ALL HAVING count(*) > 1) r USING (doc_id, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
stats AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM base LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (10000 * n_symbols) // greatest(n_words, 1) AS symbols,
    (1000 * word_chars) // greatest(n_words, 1) AS word_length, (10000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines,
    (10000 * n_repeat_words) // greatest(n_words, 1) AS repeats FROM stats),
hist AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
    FROM (UNPIVOT (SELECT lang, source, symbols, word_length, dup_lines, repeats FROM m WHERE NOT base_failed) ON symbols, word_length, dup_lines, repeats INTO NAME metric VALUE v)
    WHERE v > 0 OR metric = 'word_length' GROUP BY ALL),
{_LEVELS}
limits AS (SELECT g.lang, g.source, {', '.join(f"max({side}) FILTER (metric = '{m}') AS {side}_{m}" for m in _METRICS for side in ('low', 'high'))}
    FROM groups g LEFT JOIN f_own o ON o.lang = g.lang AND o.source = g.source GROUP BY g.lang, g.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_OUT}, false) AS kept
FROM m JOIN limits USING (lang, source)
"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULES = (("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"))
OP4 = rf"""
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, v in _RULES)} END AS rule,
    CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _RULES)} END AS own,
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') AS h,
    regexp_replace(regexp_replace(regexp_replace(path, '(/\.)+(/|$)', '/', 'g'), '/+', '/', 'g'), '(\.html?)?/?$', '') AS p FROM parts),
c AS (SELECT *, CASE WHEN h <> '' THEN h || p END AS canonical FROM ruled),
listed AS (SELECT DISTINCT canonical FROM c WHERE own = 'block' AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""

OP1 = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT kind, id, len(w) AS n, p, w[p + 1:p + 5] AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM words WHERE len(w) >= 5)),
items AS (SELECT id AS item_id, n, p AS q, g FROM s WHERE kind = 'i'),
docs AS (SELECT id AS doc_id, n AS dn, p, g FROM s WHERE kind = 'd' AND id IN (SELECT DISTINCT a.id FROM s a JOIN items USING (g) WHERE a.kind = 'd')),
windows AS (SELECT DISTINCT doc_id, n, greatest(0, least(p - q, dn - n)) AS start FROM docs JOIN items USING (g)),
wide AS (SELECT DISTINCT doc_id, item_id, n, start FROM windows JOIN (SELECT DISTINCT item_id, n FROM items) USING (n)),
inside AS (SELECT doc_id, n, start, g, count(*) AS c FROM windows JOIN docs USING (doc_id) WHERE p >= start AND p < start + n - 4 GROUP BY ALL),
sizes AS (SELECT doc_id, n, start, sum(c) AS size FROM inside GROUP BY ALL),
own AS (SELECT item_id, n, g, count(*) AS c FROM items GROUP BY ALL),
own_size AS (SELECT item_id, sum(c) AS size FROM own GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, n, start, sum(least(inside.c, own.c)) AS both_ FROM inside JOIN own USING (n, g) GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, both_, sizes.size + own_size.size - both_ AS all_ FROM both_ JOIN sizes USING (doc_id, n, start) JOIN own_size USING (item_id)),
short AS (SELECT id AS item_id, len(w) AS n, w FROM words WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4),
good AS (SELECT doc_id, item_id, start, ((100 * both_) // all_)::BIGINT AS similarity FROM scored WHERE 100 * both_ >= 80 * all_
    UNION ALL SELECT d.id, item_id, p, 100 FROM (SELECT id, w, unnest(range(0, len(w))) AS p FROM words WHERE kind = 'd' AND EXISTS (FROM short)) d JOIN short ON d.w[p + 1:p + n] = short.w)
SELECT doc_id, item_id, start::BIGINT AS start, similarity FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

SQL = {"op1_decontamination": OP1, "op3_quality_rules": OP3, "op4_url_filters": OP4}
