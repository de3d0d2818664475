"""SQL of the operators that SQL can express; each runs over the whole tables."""

from __future__ import annotations

from .quality_rules import MARKS, RULES, STEPS, SYMBOLS, UPPER

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def quality_rules(alpha: float = 0.05, delta: float = 0.05, price: float = 3.0) -> str:
    share = alpha / len(RULES)
    rate = ", ".join(f"CASE WHEN {d} > 0 THEN least({STEPS}, {STEPS} * {n} // {d}) ELSE 0 END AS r_{r}" for r, (n, d) in RULES.items())
    cells = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, r_{r} AS rate, quality FROM held WHERE r_{r} > 0" for r in RULES)
    rejected = " OR ".join(f"EXISTS (SELECT 1 FROM best b WHERE b.stratum = s.stratum AND b.rule = '{r}' AND s.r_{r} >= b.cutoff)" for r in RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(text="text")} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
counted AS (SELECT w.doc_id, stratum, len(ws)::bigint AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols, (length(text) - length(translate(text, '{UPPER}', '')))::bigint AS n_upper,
  (length(text) - length(translate(text, '{MARKS}', '')))::bigint AS n_marks, len(ls)::bigint AS n_lines, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
  coalesce(inside.n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN inside ON w.doc_id = inside.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rate} FROM counted),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = max(quality)),
held AS (SELECT s.*, quality FROM s JOIN truth ON s.doc_id = truth.doc_id WHERE NOT base_failed),
sizes AS (SELECT stratum, count(*) FILTER (quality = 1) AS n FROM held GROUP BY 1),
cells AS ({cells}),
sums AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS k, count(*) FILTER (quality = 0) AS bad FROM (SELECT *, unnest(range(1, rate + 1)) AS cutoff FROM cells) GROUP BY ALL),
tests AS (SELECT sums.*, n, {delta} / ((SELECT count(*) FROM sizes) * {len(RULES) * STEPS}) AS level FROM sums JOIN sizes ON sums.stratum = sizes.stratum WHERE k < n * {share!r} AND bad > k * {price}),
ok AS (SELECT * FROM tests WHERE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j < 2 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({share!r}) + (n - j) * ln(1 - {share!r})))) <= level),
best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - k * {price} DESC, cutoff DESC) AS place FROM ok) WHERE place = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept,
  {", ".join(f"r_{r}::int AS {r}_rate" for r in RULES)} FROM s
"""


def ngram_groups(words: int = 3, percent: int = 90) -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, {gram} AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {words - 2})) AS i FROM w WHERE len(ws) >= {words})
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {words - 1})),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_have >= {percent} * (p.n + q.n - both_have)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::bigint AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON reach.doc_id = n.doc_id GROUP BY reach.doc_id
"""


def repeated_passages(length: int = 400, covered: int = 300) -> str:
    def runs(of: int, name: str) -> str:
        return f"""
s{name} AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * of})) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {of} + 1)) AS i FROM t)),
twice{name} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM s{name}) WHERE n > 1),
marked{name} AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {of} THEN 0 ELSE 1 END AS new FROM twice{name}),
runs{name} AS (SELECT doc_id, min(i) AS a, max(i) + {of} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked{name}) GROUP BY doc_id, run)"""

    return f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),{runs(length, "")},{runs(covered, "_c")},
cover AS (SELECT doc_id, sum(b - a) AS n_covered FROM runs_c GROUP BY 1),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM parts p JOIN t ON p.doc_id = t.doc_id GROUP BY 1)
SELECT t.doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256, coalesce(n_covered, 0)::bigint AS n_covered
FROM t LEFT JOIN kept k ON t.doc_id = k.doc_id LEFT JOIN cover ON t.doc_id = cover.doc_id
"""
