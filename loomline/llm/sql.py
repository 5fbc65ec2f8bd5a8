"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from loomline.llm import quality_rules, secret_scan, sharding

_SPACE = "[\\x20\\x09-\\x0D]+"
_VISIBLE = "[^\\x20\\x09-\\x0D]"


def _secrets() -> str:
    parts, rules = [], secret_scan.RULES
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS k, '{r.kind}' AS kind, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, "
            f"regexp_extract_all(text, '{pattern}', {r.group}) AS vals, {r.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
one AS (SELECT rid, k, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS j FROM m WHERE len(hits) > 0),
laid AS (SELECT rid, k, kind, length(hits[j]) AS n, length(vals[j]) AS v, least,
  list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j-1], lambda x: length(x))), 0) AS s FROM one),
spans AS (SELECT rid, k, CAST(s AS BIGINT) AS s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS t FROM laid WHERE v >= least),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(t, ',' ORDER BY s, k) FILTER (k < {secret_scan.BASE_KINDS}) AS b, string_agg(t, ',' ORDER BY s, k) AS a FROM spans GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)"""


def _sharding() -> str:
    shards = list(sharding.lookup_table(sharding.shard_names()))
    return f"""
WITH t AS (SELECT {shards} AS shards),
s AS (SELECT doc_id, n_chars, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) % {sharding.SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, n_chars, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM s, t"""


def _quality() -> str:
    w = quality_rules.WINDOW
    bits = " + ".join(f"CASE WHEN {c} THEN {quality_rules.BITS[n]} ELSE 0 END" for n, c in quality_rules.RULES)
    policy, base = quality_rules.STANDARD, quality_rules.BASE
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_VISIBLE}')) AS lines FROM d),
v AS (SELECT rid, unnest(list_transform(range(1, len(words) - {w - 2}), lambda i: struct_pack(i := i, t := array_to_string(words[i:i + {w - 1}], ' ')))) AS u FROM s WHERE len(words) >= {w}),
x AS (SELECT rid, u.i AS i, count(*) OVER (PARTITION BY rid, u.t) AS n FROM v),
y AS (SELECT rid, least({w}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {w})) AS c FROM x WHERE n > 1),
z AS (SELECT rid, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM y GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '{quality_rules.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS BIGINT) AS n_stutters
  FROM s LEFT JOIN z USING (rid)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base.mask}) <> 0 AS base_failed,
  (fail_bits & {policy.mask}) = 0 AS kept, n_lines, n_upper, n_exclaims, n_stutters, fail_bits, {policy.version} AS policy_version FROM b"""


ORACLES = {
    "op1_secret_scan": _secrets(),
    "op6_sharding": _sharding(),
    "op10_quality_rules": _quality(),
}
