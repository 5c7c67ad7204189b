"""DuckDB SQL of the quality rules and the secret scan, written from their definitions, not from their Spark plans."""

from __future__ import annotations

from . import quality, secrets

_WORD = r"[^\x20\x09-\x0D]"


def _quartiles(keys: list[str]) -> str:
    """First and third quartile bucket by keys and measure of the table `pairs`."""
    by = ", ".join([*keys, "measure"])
    return f"""
  SELECT {by}, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS support
  FROM (SELECT {by}, bucket, count(*) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, count(*) OVER (PARTITION BY {by}) AS total FROM pairs)
  GROUP BY {by}"""


def quality_sql() -> str:
    k = quality.WINDOW
    values = quality.values()
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v.replace(' div ', ' // ')} AS v FROM measured WHERE NOT base_failed" for m, v in values.items())
    floors = " ".join(f"WHEN '{m}' THEN {least}" for m, least in quality.MEASURES.items())
    fence = ", ".join(
        [f"max(q3 + spread) FILTER (measure = '{m}') AS high_{m}" for m in values]
        + [f"max(q1 - spread) FILTER (measure = '{m}') AS low_{m}" for m in quality.TWO_SIDED]
    )
    held = [f"{v.replace(' div ', ' // ')} <= high_{m}" for m, v in values.items()]
    held += [f"{values[m].replace(' div ', ' // ')} >= low_{m}" for m in quality.TWO_SIDED]
    pick = ", ".join(f"CASE WHEN o.support >= {quality.SUPPORT} THEN o.{q} WHEN l.support >= {quality.SUPPORT} THEN l.{q} ELSE e.{q} END AS {q}" for q in ("q1", "q3"))
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents
), cut AS (
  SELECT *, regexp_extract_all(body, '{_WORD}+') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM rows
), windows AS (
  SELECT rid, i, w[i:i + {k - 1}] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {k - 2})) AS i FROM cut)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(least({k}, coalesce(following - i, {k}))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM again) GROUP BY rid
), counted AS (
  SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (rid)
), measured AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
), pairs AS (
  SELECT lang, source, measure, (v >> s) << s AS bucket FROM (SELECT *, CAST(greatest(0, length(bin(v)) - 6) AS BIGINT) AS s FROM ({pairs}))
), own AS ({_quartiles(["lang", "source"])}
), langs AS ({_quartiles(["lang"])}
), everything AS ({_quartiles([])}
), picked AS (
  SELECT o.lang, o.source, o.measure, {pick}
  FROM own o JOIN langs l ON o.lang = l.lang AND o.measure = l.measure JOIN everything e ON o.measure = e.measure
), fences AS (
  SELECT lang, source, {fence}
  FROM (SELECT *, greatest({quality.SPREADS} * (q3 - q1), CASE measure {floors} END) AS spread FROM picked) GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(held)} END AS kept
FROM measured LEFT JOIN fences USING (lang, source)
"""


def _spans(pattern: str, kind: str, role: str, value: int = 0, least: int = 0, most: int = 1 << 30) -> str:
    """Matches as rid, start, past, kind, role: the texts before a match and the matches before it, laid end to end."""
    p = "'" + pattern.replace("'", "''") + "'"
    lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    return f"""
  SELECT rid, start, start + length(found[k]) AS past, '{kind}' AS kind, '{role}' AS role FROM (
    SELECT *, {lengths.format("before[1:k]")} + {lengths.format("found[1:k - 1]")} AS start FROM (
      SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
        SELECT rid, string_split_regex(body, {p}) AS before, regexp_extract_all(body, {p}) AS found, regexp_extract_all(body, {p}, {value}) AS held
        FROM rows WHERE regexp_matches(body, {p}))))
  WHERE length(held[k]) BETWEEN {least} AND {most}"""


def secrets_sql() -> str:
    base = [
        _spans(secrets.ASSIGN, "assign", "secret", 2, 12),
        _spans(secrets.ACCESS, "access", "ident", 0, 18),
        _spans(secrets.HEX, "hex", "secret"),
    ]
    weak = [
        _spans(secrets.ASSIGN, "weak", "secret", 2, 1, 11),
        _spans(secrets.LOOSE, "weak", "secret", 2),
        _spans(secrets.OPAQUE, "weak", "secret"),
        _spans(secrets.LOGIN, "weak", "ident", 2),
    ]
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.KINDS)) + " END"
    joined = f"string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, {rank}, past)"
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS[:3])
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents
), base AS ({" UNION ALL ".join(base)}
), weak AS ({" UNION ALL ".join(weak)}
), endpoints AS ({_spans(secrets.ENDPOINT, "endpoint", "endpoint")}
), held AS (
  SELECT * FROM base UNION ALL SELECT * FROM weak UNION ALL SELECT * FROM endpoints
), linked AS (
  SELECT DISTINCT w.rid, w.start, w.past, w.kind
  FROM weak w JOIN held h ON w.rid = h.rid AND w.role <> h.role AND h.start < w.past + {secrets.REACH} AND h.past > w.start - {secrets.REACH}
), every AS (
  SELECT rid, start, past, kind FROM base UNION ALL SELECT * FROM linked
), grouped AS (
  SELECT rid, {count}, {joined} FILTER (kind <> 'weak') AS strong, {joined} AS spans FROM every GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(strong, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN grouped USING (rid)
"""
