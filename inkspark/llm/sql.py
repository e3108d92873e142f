"""DuckDB SQL for the queries of operators that SQL can express, over the same tables."""

from __future__ import annotations

import re

from .licenses import TEMPLATES, LicenseParams, window_class
from .line_dedup import LineDedupParams
from .url_filter import RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan(params: LicenseParams = LicenseParams()) -> str:
    """All windows against all templates; the operator's bands only save work."""
    rows = []
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            quoted = text.replace("'", "''")
            k, size, step = window_class(len(re.findall(r"[a-z0-9]+", text.lower())))
            rows.append(f"('{name}', {i}, {k}, {size}, {step}, '{quoted}')")
    split = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) v(license, template, k, size, step, body)),
tw AS (SELECT * EXCLUDE body, {split.format("body")} AS w FROM t),
ts AS (SELECT DISTINCT license, template, k, size, step, array_to_string(w[i : i + k - 1], ' ') AS s FROM tw, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
tn AS (SELECT license, template, count(*) AS n FROM ts GROUP BY ALL),
dw AS (SELECT doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
dk AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM t)),
ds AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS s FROM dk),
hit AS (SELECT doc_id, license, template, ts.k, size, step, pos, s FROM ds JOIN ts USING (k, s)),
placed AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - size + 1) / step) * step) AS BIGINT), pos + 1, step)) AS w0 FROM hit),
aligned AS (SELECT * FROM placed WHERE w0 % step = 0 AND w0 <= pos AND pos < w0 + size),
held AS (SELECT doc_id, license, template, k, size, w0, count(DISTINCT s) AS c FROM aligned GROUP BY ALL),
ok AS (SELECT held.*, c / n AS share FROM held JOIN tn USING (license, template) WHERE c / n >= {params.containment})
SELECT doc_id, license, max(share) AS containment, CAST(arg_min(w0, struct_pack(a := -share, b := w0)) AS BIGINT) AS first_word, count(DISTINCT (k, size, w0)) AS n_windows
FROM ok GROUP BY doc_id, license"""


NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, min(d.doc_id) OVER (PARTITION BY CASE WHEN n.n > 0 THEN c.x ELSE CAST(d.doc_id AS VARCHAR) END) AS class_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
LEFT JOIN (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS x FROM s GROUP BY 1) c ON c.doc_id = d.doc_id"""


def line_dedup(params: LineDedupParams = LineDedupParams()) -> str:
    """Exact numbers of sites; ids are taken as unique, as in the tables."""
    return f"""
WITH l AS (SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS parts, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, site, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
f AS (SELECT *, {params.min_sites} + {params.short_sites} * greatest(0, {params.min_words} - len(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'))) AS need FROM t WHERE x <> ''),
wide AS (SELECT x, arg_min(doc_id, (doc_id, pos)) AS first_id, arg_min(pos, (doc_id, pos)) AS first_pos FROM f GROUP BY x HAVING count(DISTINCT site) >= max(need)),
gone AS (SELECT doc_id, list(pos) AS gone FROM f JOIN wide USING (x) WHERE doc_id <> first_id OR pos <> first_pos GROUP BY 1)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END AS text,
coalesce(len(gone), 0) AS n_removed FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id"""


#: Twenty bits of the hexadecimal SHA-1 give four base32 digits.
WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS x FROM p),
d AS (SELECT page_id, n, list_reduce(list_transform(range(8), lambda k: list_reduce(list_transform([15, 10, 5, 0],
  lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * k, 5) AS INTEGER) >> b) & 31), 1)), lambda u, v: u || v)), lambda u, v: u || v) AS digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


def url_rules(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """Host, path, rule and the rule's verdict."""
    rows = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in rules)
    rest = "regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*')"
    return f"""
WITH r AS (SELECT * FROM (VALUES {rows}) v(verdict, rule, name, tail)),
u AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
s AS (SELECT page_id, {_FOLD.format("split_part(rest, '/', 1)")} AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM s JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, tail) GROUP BY 1)
SELECT s.page_id, host, path, rule, ruled FROM s LEFT JOIN f ON f.page_id = s.page_id"""


QUALITY_COUNTS = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan(),
    "op5_ngram_jaccard_join": NGRAM_JOIN,
    "op8_line_dedup": line_dedup(),
    "op9_warc": WARC,
    "url_rules": url_rules(),
    "quality_counts": QUALITY_COUNTS,
}
