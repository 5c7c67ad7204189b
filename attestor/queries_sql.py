"""DuckDB SQL twins of the registered queries, written against the driver's views."""

from __future__ import annotations

#: The default grid, most conservative first.
_UPPER = (0.99, 0.98, 0.97, 0.96, 0.95, 0.925, 0.90, 0.875, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55)


def _u(tag: str) -> str:
    return f"(CAST('0x' || substr(sha256('{tag}:' || code_id || ':' || item_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_P = f"""CASE WHEN {_u('u3')} < 0.08::DOUBLE THEN round(0.30::DOUBLE + 0.40::DOUBLE * {_u('u2')}, 4)
  WHEN (coalesce(g, 0) = 1) <> ({_u('u1')} < 0.01::DOUBLE) THEN round(0.90::DOUBLE + 0.0995::DOUBLE * {_u('u2')}, 4)
  ELSE round(0.0005::DOUBLE + 0.0995::DOUBLE * {_u('u2')}, 4) END"""

_GRID = "VALUES " + ", ".join(f"({i}, {round(1 - t, 10)!r}::DOUBLE, {t!r}::DOUBLE)" for i, t in enumerate(_UPPER))

BASE = f"""
items AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, text, lang, source FROM documents),
keyed AS (SELECT item_id, sha256('5:split2:42' || strlen(item_id) || ':' || item_id) AS split_key FROM items),
numbered AS (SELECT *, row_number() OVER (ORDER BY split_key) AS rn, count(*) OVER () AS n FROM keyed),
splits AS (SELECT item_id, split_key, rn, CASE WHEN rn <= round_even(0.10::DOUBLE * n, 0) THEN 'dev'
  WHEN rn <= round_even(0.10::DOUBLE * n, 0) + round_even(0.45::DOUBLE * n, 0) THEN 'calibration' ELSE 'test' END AS split FROM numbered),
codes(code_id) AS (VALUES ('toxic'), ('high_quality')),
gold AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, 'toxic' AS code_id, toxic AS g FROM labels
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'high_quality', quality FROM labels),
scores AS (SELECT item_id, code_id, {_P} AS p FROM items CROSS JOIN codes LEFT JOIN gold USING (item_id, code_id)),
gs AS (SELECT gold.code_id, item_id, split, {_P} AS p, g, CASE WHEN {_u('pi')} < 0.5 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM gold JOIN splits USING (item_id)),
even AS (SELECT * REPLACE (1.0::DOUBLE AS w) FROM gs),
grid AS (SELECT *, t_hi - t_lo AS band_width FROM ({_GRID}) AS v(band_id, t_lo, t_hi)),
records AS (
  SELECT item_id, code_id, split, g AS label, 'coder_1' AS coder, item_id::BIGINT * 10 + 1 AS seq, CASE WHEN {_u('pi')} < 0.5 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS pi FROM gold JOIN splits USING (item_id)
  UNION ALL SELECT item_id, code_id, split, CASE WHEN {_u('flip')} < 0.10::DOUBLE THEN 1 - g ELSE g END, 'coder_2', item_id::BIGINT * 10 + 2, CASE WHEN {_u('pi')} < 0.5 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END FROM gold JOIN splits USING (item_id) WHERE {_u('overlap')} < 0.25::DOUBLE
  UNION ALL SELECT item_id, code_id, split, 1 - g, 'coder_1', item_id::BIGINT * 10, CASE WHEN {_u('pi')} < 0.5 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END FROM gold JOIN splits USING (item_id) WHERE {_u('old')} < 0.05::DOUBLE
),
latest AS (SELECT item_id, code_id, coder, arg_max(label, seq) AS label, arg_max(split, seq) AS split, arg_max(pi, seq) AS pi, max(seq) AS seq, min(seq) AS first_seq FROM records GROUP BY ALL)
"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + body


def _cells(decided: str, weight: str = "w", gold: str = "g") -> str:
    return ", ".join(f"coalesce(sum({weight}) FILTER (WHERE {gold} = {x} AND ({decided}) = {y}), 0) AS {n}" for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0)))


_N = "(a + b + c + d)"
_PO, _PE = f"((a + d) / {_N})", f"(((a + b) * (a + c) + (c + d) * (b + d)) / ({_N} * {_N}))"
KAPPA = f"CASE WHEN {_N} > 0 THEN CASE WHEN 1 - {_PE} > 1e-12 THEN ({_PO} - {_PE}) / (1 - {_PE}) END END"
REASON = f"CASE WHEN {_N} <= 0 THEN 'EMPTY_INPUT' WHEN 1 - {_PE} <= 1e-12 THEN 'DEGENERATE_SINGLE_CLASS' END"
_X, _M = "(2 * a + b + c)", f"(2 * {_N})"
ALPHA = f"CASE WHEN {_M} > 1 THEN CASE WHEN 2 * {_X} * ({_M} - {_X}) / ({_M} - 1) > 1e-12 THEN 1 - 2 * (b + c) / (2 * {_X} * ({_M} - {_X}) / ({_M} - 1)) END END"
_ACC, _DEC = "(p >= t_hi OR p <= t_lo)", "CASE WHEN p >= t_hi THEN 1 WHEN p <= t_lo THEN 0 END"


def _candidates(source: str, alpha: float) -> tuple[str, ...]:
    """CTEs met, agg, sized and cand for the calibration rows of gs or even."""
    per = ", ".join(
        f"count(*) FILTER (WHERE acc AND g = {y}) AS {n}_n, coalesce(sum(w) FILTER (WHERE acc AND g = {y}), 0) AS {n}_w, coalesce(sum(w * w) FILTER (WHERE acc AND g = {y}), 0) AS {n}_ww, coalesce(sum(w) FILTER (WHERE acc AND g = {y} AND dec <> {y}), 0) AS {n}_errors"
        for n, y in (("pos", 1), ("neg", 0))
    )
    size = ", ".join(
        f"CASE WHEN {n}_w > 0 THEN {n}_errors / {n}_w END AS {n}_risk, CASE WHEN {n}_ww > 0 THEN {n}_w * {n}_w / {n}_ww ELSE 0 END AS {n}_eff, CAST(floor(CASE WHEN {n}_ww > 0 THEN {n}_w * {n}_w / {n}_ww ELSE 0 END + 1e-9) AS BIGINT) AS {n}_size, CAST(ceil(CASE WHEN {n}_w > 0 THEN {n}_errors / {n}_w END * floor(CASE WHEN {n}_ww > 0 THEN {n}_w * {n}_w / {n}_ww ELSE 0 END + 1e-9) - 1e-9) AS BIGINT) AS {n}_fails"
        for n in ("pos", "neg")
    )
    tail = lambda n: f"""{n}_tail AS (SELECT code_id, band_id, CASE WHEN {n}_size < 1 OR {n}_risk IS NULL THEN 1 ELSE least(1, sum(exp(lgamma({n}_size + 1) - lgamma(k + 1) - lgamma({n}_size - k + 1) + k * ln({alpha!r}::DOUBLE) + ({n}_size - k) * ln(1 - {alpha!r}::DOUBLE)))) END AS {n}_p
      FROM sized LEFT JOIN (SELECT range AS k FROM range(0, 100000)) ON k <= {n}_fails AND {n}_size >= 1 GROUP BY code_id, band_id, {n}_size, {n}_risk)"""  # noqa: E731
    return (
        f"met AS (SELECT *, {_ACC} AS acc, {_DEC} AS dec FROM {source} CROSS JOIN grid WHERE split = 'calibration')",
        f"agg AS (SELECT code_id, band_id, t_lo, t_hi, band_width, coalesce(sum(w) FILTER (WHERE acc), 0) / sum(w) AS coverage, count(*) FILTER (WHERE acc) AS n_accepted, {per} FROM met GROUP BY ALL)",
        f"sized AS (SELECT *, {size}, 0.05::DOUBLE * pow(2.0::DOUBLE, -least(row_number() OVER (PARTITION BY code_id ORDER BY band_width, t_hi DESC), 14)) AS delta_share FROM agg)",
        tail("pos"), tail("neg"),
        "cand AS (SELECT *, pos_p <= delta_share AND neg_p <= delta_share AS valid FROM sized JOIN pos_tail USING (code_id, band_id) JOIN neg_tail USING (code_id, band_id))",
    )


def _fitted(source: str) -> tuple[str, ...]:
    return (
        *_candidates(source, 0.20),
        f"""counted AS (SELECT code_id, count(*) AS n_gold, CAST(sum(g) AS BIGINT) AS n_gold_positive, max(w) - min(w) <= 1e-8 + 1e-5 * abs(min(w)) AS exact FROM {source} WHERE split = 'calibration' GROUP BY code_id)""",
        "best AS (SELECT code_id, arg_max(struct_pack(lo := t_lo, hi := t_hi, cov := coverage, share := delta_share), (coverage, band_width)) AS best FROM cand WHERE valid GROUP BY code_id)",
        """fitted AS (SELECT counted.*, CASE WHEN n_gold_positive >= 15 THEN best.lo END AS t_lo, CASE WHEN n_gold_positive >= 15 THEN best.hi END AS t_hi, CASE WHEN n_gold_positive >= 15 THEN best.cov END AS coverage, CASE WHEN n_gold_positive >= 15 THEN best.share END AS delta_share,
          CASE WHEN n_gold_positive < 15 THEN 'INSUFFICIENT_EVIDENCE' WHEN best IS NULL THEN 'NOT_AUTOMATABLE' ELSE 'ok' END AS verdict,
          CASE WHEN n_gold_positive < 15 THEN 'INSUFFICIENT_EVIDENCE' WHEN best IS NULL THEN 'NO_VALID_THRESHOLD' END AS reason FROM counted LEFT JOIN best USING (code_id))""",
    )


def _certified(source: str) -> tuple[str, ...]:
    return (
        *_fitted(source),
        f"tested AS (SELECT code_id, count(*) AS n_test, CAST(sum(g) AS BIGINT) AS n_test_positive FROM {source} WHERE split = 'test' GROUP BY code_id)",
        f"final AS (SELECT e.code_id, {_cells(f'CASE WHEN {_ACC} THEN {_DEC} ELSE g END')} FROM {source} e JOIN fitted f ON e.code_id = f.code_id WHERE split = 'test' AND t_hi IS NOT NULL GROUP BY e.code_id)",
        f"k AS (SELECT code_id, {KAPPA} AS k FROM final)",
        """graded AS (SELECT f.code_id, n_gold, n_gold_positive, exact, delta_share, t_lo, t_hi, coverage, coalesce(n_test, 0) AS n_test, coalesce(n_test_positive, 0) AS n_test_positive, CASE WHEN n_test_positive >= 15 THEN k END AS kappa, verdict AS v, reason AS r
          FROM fitted f LEFT JOIN tested USING (code_id) LEFT JOIN k USING (code_id))""",
        """certified AS (SELECT * EXCLUDE (v, r), CASE WHEN v <> 'ok' THEN v WHEN kappa IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN kappa < 0.70::DOUBLE THEN 'NOT_AUTOMATABLE' WHEN kappa < 0.75::DOUBLE THEN 'weak' ELSE 'ok' END AS verdict,
          CASE WHEN v <> 'ok' THEN r WHEN kappa IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN kappa < 0.70::DOUBLE THEN 'BELOW_PUBLICATION_BAR' END AS reason FROM graded)""",
    )


_CERTIFIED = _certified("even")

_DECIDED = (
    "human AS (SELECT item_id, code_id, label AS human FROM records WHERE coder = 'coder_2' AND label = 1)",
    "known AS (SELECT item_id, code_id, p FROM scores JOIN items USING (item_id) WHERE lang <> 'de')",
    "bands(code_id, t_lo, t_hi) AS (VALUES ('toxic', 0.40::DOUBLE, 0.60::DOUBLE))",
    f"""decided AS (SELECT item_id, code_id, coalesce(human, {_DEC}) AS label, p AS probability,
      CASE WHEN human IS NOT NULL THEN 'human' WHEN t_hi IS NULL THEN 'not_automatable' WHEN {_DEC} IS NULL THEN 'abstain_unreviewed' ELSE 'auto' END AS source
      FROM items CROSS JOIN codes LEFT JOIN known USING (item_id, code_id) LEFT JOIN human USING (item_id, code_id) LEFT JOIN bands USING (code_id))""",
)

_POOL = "pool AS (SELECT item_id, p FROM scores WHERE code_id = 'toxic' ORDER BY p DESC, item_id LIMIT greatest(1, (SELECT CAST(round_even(0.2::DOUBLE * count(*), 0) AS BIGINT) FROM items)))"
_UNIFORM = """uniform AS (SELECT item_id, 'calibration' AS split, 'uniform' AS stratum, 60::DOUBLE / (SELECT count(*) FROM splits WHERE split = 'calibration') AS inclusion_probability
  FROM splits WHERE split = 'calibration' ORDER BY sha256('7:calibration:uniform:' || item_id) LIMIT 60)"""

_HASH = "sha256('4:item' || strlen(text) || ':' || text)"
_LOOKED = (
    f"cells AS (SELECT item_id, code_id, lang, sha256('5:cache8:recorded2:v164:' || {_HASH} || strlen(code_id) || ':' || code_id || '2:' || code_hash) AS key FROM items CROSS JOIN (VALUES ('toxic', 'c1'), ('high_quality', 'c2')) AS v(code_id, code_hash))",
    "held AS (SELECT DISTINCT key, 0.5::DOUBLE AS cached FROM cells WHERE lang = 'en')",
    "looked AS (SELECT * FROM cells LEFT JOIN held USING (key))",
)

_RAN = (
    "early AS (SELECT DISTINCT text AS t FROM items WHERE lang = 'en')",
    """ran AS (SELECT item_id, code_id, text, CASE WHEN early.t IS NOT NULL THEN 0.5::DOUBLE WHEN code_id = 'toxic' AND length(text) % 10 = 0 THEN NULL ELSE length(text) % 100 / 100.0::DOUBLE END AS probability
      FROM items CROSS JOIN codes LEFT JOIN early ON text = t WHERE text <> '')""",
)

_DRAWS = (
    "t AS (SELECT * FROM even WHERE split = 'test')",
    "ranked AS (SELECT t.*, rep, row_number() OVER (PARTITION BY code_id, rep ORDER BY sha256('0:' || rep || ':' || code_id || ':' || item_id)) AS rank, count(*) OVER (PARTITION BY code_id, rep) AS n FROM t CROSS JOIN (SELECT range AS rep FROM range(0, 100)))",
    f"each AS (SELECT code_id, point, rep, {_cells('CASE WHEN rank <= round_even(point / 4.0::DOUBLE * n, 0) THEN g WHEN p >= 0.5 THEN 1 ELSE 0 END')} FROM ranked CROSS JOIN (SELECT CAST(range AS INTEGER) AS point FROM range(0, 5)) GROUP BY code_id, point, rep)",
    f"drawn AS (SELECT code_id, point, {KAPPA} AS kappa FROM each)",
    "baseline AS (SELECT code_id, point, point / 4.0::DOUBLE AS labour, 1 - point / 4.0::DOUBLE AS coverage, avg(kappa) AS kappa, quantile_cont(kappa, 0.025::DOUBLE) AS lo, quantile_cont(kappa, 0.975::DOUBLE) AS hi FROM drawn GROUP BY code_id, point)",
)


_PAIRS = "SELECT x.code_id, x.item_id, x.label AS f, y.label AS s FROM latest x JOIN latest y ON x.item_id = y.item_id AND x.code_id = y.code_id AND x.coder = 'coder_1' AND y.coder = 'coder_2'"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' \n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _folded(pieces: str, glue: str, room: int, tail: str = "''") -> str:
    """Pieces laid end to end with `glue` while a run keeps within `room`; a new run opens with `tail` of the one before."""
    joined = f"a[len(a)] || {glue} || b[1]"
    opened = f"CASE WHEN {tail} <> '' THEN {tail} || {glue} || b[1] ELSE b[1] END"
    return f"list_reduce(list_transform({pieces}, lambda x: [x]), lambda a, b: CASE WHEN length({joined}) <= {room} THEN list_concat(a[1:len(a) - 1], [{joined}]) ELSE list_concat(a, [{opened}]) END)"


#: A sentence over the room is wrapped at spaces; no word of the tables is longer than a passage.
_RUNS = _folded("string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))", "' '", 4000)
_CHUNKED = (
    f"""pieces AS (SELECT item_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS paragraphs FROM (SELECT item_id, trim(text, {_BLANK}) AS t FROM items WHERE text <> ''))""",
    f"""sentences AS (SELECT item_id, t, flatten(list_transform(paragraphs, lambda p: CASE WHEN length(p) <= 4000 THEN [p] ELSE {_RUNS} END)) AS runs FROM pieces)""",
    f"""fitting AS (SELECT item_id, t, flatten(list_transform(runs, lambda r: CASE WHEN length(r) <= 4000 THEN [r] ELSE {_folded("string_split(r, ' ')", "' '", 3999)} END)) AS pieces FROM sentences)""",
    f"""chunked AS (SELECT item_id, CASE WHEN length(t) // 4 + 1 <= 1000 THEN [t] ELSE {_folded("pieces", "chr(10) || chr(10)", 4000, f"ltrim(a[len(a)][-80:], {_BLANK})")} END AS chunks FROM fitting)""",
)


def _labour(source: str, offset: float) -> tuple[str, ...]:
    return (
        "points AS (SELECT 0 AS point, NULL::DOUBLE AS t_lo, NULL::DOUBLE AS t_hi UNION ALL SELECT 15 - band_id, t_lo, t_hi FROM grid)",
        f"""curve0 AS (SELECT code_id, point, t_hi, count(*) AS n, sum(CASE WHEN t_hi IS NULL OR {_ACC} THEN w ELSE 0 END) / sum(w) AS coverage,
          {_cells(f'CASE WHEN t_hi IS NULL THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END WHEN {_ACC} THEN {_DEC} ELSE g END')} FROM {source} CROSS JOIN points WHERE split = 'test' GROUP BY ALL)""",
        f"curve AS (SELECT code_id, point, t_hi, n, coverage, least(1, greatest(0, {offset}::DOUBLE + 1 - coverage)) AS labour, {KAPPA} AS kappa, {REASON} AS reason FROM curve0)",
    )


def _round(columns: str, *doubles: str) -> str:
    return ", ".join([columns, *(f"round({d}, 6) AS {d}" for d in doubles)])


SQL: dict[str, str] = {
    "certify": _with("SELECT " + _round("code_id, n_gold, n_gold_positive, n_test, n_test_positive, verdict, reason", "t_lo", "t_hi", "coverage", "kappa") + " FROM certified", *_CERTIFIED),
    "split_assignment": _with("SELECT item_id, split_key, rn, split FROM splits"),
    "split_counts": _with("SELECT s AS split, count(split) AS n FROM (VALUES ('dev'), ('calibration'), ('test')) AS v(s) LEFT JOIN splits ON split = s GROUP BY s"),
    "split_violations": _with("SELECT DISTINCT item_id, split FROM gold LEFT JOIN splits USING (item_id) WHERE split IS DISTINCT FROM 'calibration'"),
    "item_hashes": r"""
      WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' \n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
      SELECT item_id, length(t) AS n_chars, sha256('4:item' || strlen(t) || ':' || t) AS item_hash, length(t) // 4 + 1 AS n_tokens FROM n""",
    "corpus_digest": _with(f"SELECT sha256('6:corpus' || string_agg('64:' || h, '' ORDER BY h)) AS corpus_hash FROM (SELECT {_HASH} AS h FROM items)"),
    "length_stats": _with("SELECT n, min, round(median, 6) AS median, round(mean, 6) AS mean, p95, max FROM (SELECT count(*) AS n, min(length(text)) AS min, median(length(text))::DOUBLE AS median, avg(length(text)) AS mean, (list(length(text) ORDER BY length(text)))[1 + least(count(*) - 1, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT))] AS p95, max(length(text)) AS max FROM items)"),
    "confusion": _with(f"SELECT code_id, n, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round({_PO}, 6) AS agreement, round({KAPPA}, 6) AS kappa, {REASON} AS kappa_reason, round({ALPHA}, 6) AS alpha FROM (SELECT code_id, count(*) AS n, {_cells('CASE WHEN p >= 0.5 THEN 1 ELSE 0 END')} FROM gs GROUP BY code_id)"),
    "effective_sizes": _with("SELECT code_id, g, round(sum(p * w) / sum(w), 6) AS mean_p, round(sum(w) * sum(w) / sum(w * w), 6) AS n_eff FROM gs GROUP BY ALL"),
    "brier": _with("SELECT code_id, count(*) AS n, round(sum(w * (p - g) * (p - g)) / sum(w), 6) AS brier FROM gs GROUP BY code_id"),
    "reliability": _with(
        "SELECT code_id, bin, round(bin / 10.0::DOUBLE, 6) AS lo, round((bin + 1) / 10.0::DOUBLE, 6) AS hi, count(p) AS n, round(coalesce(sum(w), 0), 6) AS weight, round(sum(p * w) / sum(w), 6) AS predicted, round(sum(g * w) / sum(w), 6) AS observed FROM (SELECT DISTINCT code_id FROM gold) CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 10)) LEFT JOIN binned USING (code_id, bin) GROUP BY ALL",
        "binned AS (SELECT *, CAST(greatest(0, least(9, floor(p * 10))) AS INTEGER) AS bin FROM gs)",
    ),
    "calibration_error": _with("SELECT code_id, round(sum(gap) / sum(weight), 6) AS ece FROM (SELECT code_id, sum(w) AS weight, abs(sum(p * w) - sum(g * w)) AS gap FROM gs GROUP BY code_id, greatest(0, least(9, floor(p * 10)))) GROUP BY code_id"),
    "band_grid": _with("SELECT " + _round("band_id", "t_lo", "t_hi", "band_width") + " FROM grid"),
    "band_candidates": _with("SELECT " + _round("code_id, band_id, n_accepted, pos_n, neg_n, valid", "coverage", "pos_eff", "neg_eff", "pos_risk", "neg_risk", "pos_p", "neg_p", "delta_share") + " FROM cand", *_candidates("gs", 0.20)),
    "band_fit": _with("SELECT " + _round("code_id, n_gold, n_gold_positive, exact, verdict, reason", "t_lo", "t_hi", "coverage") + " FROM fitted", *_fitted("gs")),
    "evidence_shortfall": _with("SELECT * FROM (SELECT code_id, max(least(pos_n, neg_n)) AS have, CAST(min(ceil(ln(delta_share) / ln(1 - 0.02::DOUBLE))) AS BIGINT) AS need FROM cand WHERE pos_errors = 0 AND neg_errors = 0 AND NOT valid GROUP BY code_id) WHERE have < need", *_candidates("even", 0.02)),
    "realised_risk": _with(
        "SELECT code_id, round(sum(w * wrong) FILTER (WHERE g = 1) / sum(w) FILTER (WHERE g = 1), 6) AS positive_risk, round(sum(w * wrong) FILTER (WHERE g = 0) / sum(w) FILTER (WHERE g = 0), 6) AS negative_risk FROM (SELECT *, CASE WHEN (CASE WHEN p >= 0.6::DOUBLE THEN 1 ELSE 0 END) <> g THEN 1.0::DOUBLE ELSE 0 END AS wrong FROM gs WHERE split = 'test' AND (p >= 0.6::DOUBLE OR p <= 0.4::DOUBLE)) GROUP BY code_id"
    ),
    "selective_curve": _with(
        f"SELECT code_id, band_id, round(t_hi, 6) AS t_hi, round(coverage, 6) AS coverage, n_accepted, round({KAPPA}, 6) AS kappa, CASE WHEN n_accepted = 0 THEN 'ALL_ABSTAINED' ELSE {REASON} END AS reason, round(accuracy, 6) AS accuracy, round(prevalence, 6) AS prevalence FROM (SELECT code_id, band_id, t_hi, coalesce(sum(w) FILTER (WHERE {_ACC}), 0) / sum(w) AS coverage, count(*) FILTER (WHERE {_ACC}) AS n_accepted, sum(w) FILTER (WHERE {_ACC} AND ({_DEC}) = g) / sum(w) FILTER (WHERE {_ACC}) AS accuracy, sum(w * g) FILTER (WHERE {_ACC}) / sum(w) FILTER (WHERE {_ACC}) AS prevalence, {_cells(_DEC)} FROM gs CROSS JOIN grid WHERE split = 'test' GROUP BY ALL)"
    ),
    "labour_curve": _with("SELECT " + _round("code_id, point, n, reason", "t_hi", "coverage", "labour", "kappa") + " FROM curve", *_labour("gs", 0.05)),
    "random_baseline": _with("SELECT " + _round("code_id, point", "labour", "coverage", "kappa", "lo", "hi") + " FROM baseline", *_DRAWS),
    "bootstrap_interval": _with(
        f"SELECT code_id, count(kappa) AS defined, round(quantile_cont(kappa, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(kappa, 0.975::DOUBLE), 6) AS hi FROM (SELECT code_id, rep, {KAPPA} AS kappa FROM (SELECT x.code_id, rep, {_cells('d')} FROM picks x JOIN n USING (code_id, g, slot) GROUP BY x.code_id, rep)) GROUP BY code_id".replace("FILTER (WHERE g =", "FILTER (WHERE x.g ="),
        "n AS (SELECT code_id, g, w, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS d, row_number() OVER (PARTITION BY code_id, g ORDER BY item_id) - 1 AS slot, count(*) OVER (PARTITION BY code_id, g) AS size FROM even WHERE split = 'test')",
        "picks AS (SELECT code_id, g, rep, CAST('0x' || substr(sha256('0:' || rep || ':' || g || ':' || slot), 1, 8) AS BIGINT) % size AS slot FROM n CROSS JOIN (SELECT range AS rep FROM range(0, 2000)))",
    ),
    "most_informative": _with("SELECT code_id, round(sum(greatest(0, coalesce(curve.kappa - baseline.kappa, 0))), 6) AS gain FROM curve JOIN baseline USING (code_id, point) GROUP BY code_id ORDER BY gain DESC, code_id LIMIT 1", *_DRAWS, *_labour("even", 0.0)),
    "gold_latest": _with("SELECT item_id, code_id, coder, label, seq FROM latest"),
    "primary_coder": _with("SELECT coder FROM records GROUP BY coder ORDER BY count(*) DESC, coder DESC LIMIT 1"),
    "coded_pairs": _with("SELECT DISTINCT item_id, code_id FROM records WHERE coder = 'coder_2'"),
    "gold_labels": _with("SELECT code_id, item_id, label AS g, 1.0::DOUBLE / pi AS w FROM latest WHERE split = 'test' AND coder = 'coder_1'"),
    "double_coded": _with("SELECT x.code_id, x.item_id, x.label AS first, y.label AS second FROM latest x JOIN latest y ON x.item_id = y.item_id AND x.code_id = y.code_id AND x.coder = 'coder_1' AND y.coder = 'coder_2'"),
    "human_ceiling": _with(f"SELECT code_id, n, round({KAPPA}, 6) AS human_kappa, round({ALPHA}, 6) AS human_alpha FROM (SELECT code_id, count(*) AS n, {_cells('s', '1.0::DOUBLE', 'f')} FROM (SELECT x.code_id, x.label AS f, y.label AS s FROM latest x JOIN latest y ON x.item_id = y.item_id AND x.code_id = y.code_id AND x.coder = 'coder_1' AND y.coder = 'coder_2') GROUP BY code_id)"),
    "human_labels": _with("SELECT item_id, code_id, arg_max(label, (rank, seq)) AS label FROM (SELECT item_id, code_id, label, 0 AS rank, first_seq AS seq FROM latest UNION ALL SELECT item_id, code_id, 1, 1, seq FROM records WHERE coder = 'coder_2' AND label = 0) GROUP BY ALL"),
    "gold_summary": _with("SELECT count(DISTINCT item_id) AS gold_n, count(DISTINCT item_id) FILTER (WHERE coder <> (SELECT coder FROM records GROUP BY coder ORDER BY count(*) DESC, coder DESC LIMIT 1)) AS double_coded FROM records"),
    "plan_uniform": _with("SELECT * FROM uniform", _UNIFORM),
    "enrichment_pool": _with("SELECT item_id, p FROM pool", _POOL),
    "plan_enriched": _with(
        "SELECT item_id, 'calibration' AS split, 'enriched' AS stratum, least(1, 0.1::DOUBLE + 0.9::DOUBLE * least(40, (SELECT count(*) FROM rest)) / (SELECT count(*) FROM rest)) AS inclusion_probability FROM rest ORDER BY sha256('7:calibration:enriched:toxic:' || item_id) LIMIT 40",
        _POOL, _UNIFORM, "rest AS (SELECT item_id FROM pool WHERE item_id NOT IN (SELECT item_id FROM uniform))",
    ),
    "plan_overlap": _with("SELECT item_id FROM uniform ORDER BY sha256('7:overlap:' || item_id) LIMIT 15", _UNIFORM),
    "decisions": _with("SELECT item_id, code_id, label, probability, source FROM decided", *_DECIDED),
    "decision_sources": _with("SELECT s AS source, count(source) AS n FROM (VALUES ('auto'), ('human'), ('abstain_unreviewed'), ('not_automatable')) AS v(s) LEFT JOIN decided ON source = s GROUP BY s", *_DECIDED),
    "decision_coverage": _with("SELECT code_id, round(count(label) / count(*)::DOUBLE, 6) AS coverage FROM decided GROUP BY code_id", *_DECIDED),
    "coded_table": _with(
        "SELECT items.item_id, lang, items.source, t.label AS toxic, t.probability AS toxic_p, t.source AS toxic_src, h.label AS high_quality, h.probability AS high_quality_p, h.source AS high_quality_src FROM items LEFT JOIN decided t ON t.item_id = items.item_id AND t.code_id = 'toxic' LEFT JOIN decided h ON h.item_id = items.item_id AND h.code_id = 'high_quality'",
        *_DECIDED,
    ),
    "abstentions": _with("SELECT item_id, code_id, probability, text FROM decided JOIN items USING (item_id) WHERE decided.source = 'abstain_unreviewed'", *_DECIDED),
    "review_queue": _with("SELECT item_id, code_id, probability FROM decided WHERE source = 'abstain_unreviewed' AND (item_id, code_id) NOT IN (SELECT (item_id, code_id) FROM records WHERE coder = 'coder_2') ORDER BY abs(CASE WHEN coalesce(probability, 0) = 0 THEN 0.5 ELSE probability END - 0.5) DESC, item_id, code_id LIMIT 25", *_DECIDED),
    "code_drift": "SELECT 'item_' || item_id AS code_id, CASE WHEN length(text) >= 300 THEN 'removed' WHEN length(text) < 150 THEN 'added' WHEN contains(text, 'en') THEN 'changed' ELSE 'same' END AS change FROM benchmark",
    "passages": _with("SELECT item_id, CAST(i - 1 AS INTEGER) AS unit_index, length(c) AS n_chars, sha256('4:item' || strlen(c) || ':' || c) AS text_hash FROM (SELECT item_id, unnest(chunks) AS c, unnest(range(1, len(chunks) + 1)) AS i FROM chunked)", *_CHUNKED),
    "run_usage": _with(f"SELECT 2 * items AS lookups, 2 * early AS hits, 2 * (items - early) AS misses, round(early / items::DOUBLE, 6) AS hit_rate, texts, 2 * texts AS cells, broken AS failed, tokens AS input_tokens FROM (SELECT count(*) AS items, count(t) AS early FROM items LEFT JOIN early ON text = t WHERE text <> ''), (SELECT count(*) AS texts, count(*) FILTER (WHERE length(text) % 10 = 0) AS broken, CAST(coalesce(sum(2 * (length(text) // 4 + 1)), 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT text FROM items WHERE text <> '' AND text NOT IN (SELECT t FROM early)))", *_RAN),
    "retried_scores": _with("SELECT item_id, code_id, round(CASE WHEN early.t IS NOT NULL THEN 0.5::DOUBLE ELSE length(text) % 100 / 100.0::DOUBLE END, 6) AS probability FROM items CROSS JOIN codes LEFT JOIN early ON text = t WHERE text <> ''", _RAN[0]),
    "saved_run": _with("SELECT item_id, code_id, round(p, 6) AS probability FROM scores"),
    "saved_splits": _with("SELECT split, count(*) AS n, count(*) AS noted FROM splits GROUP BY split"),
    "gold_log_read": _with("SELECT item_id, code_id, coder, label, split, pi AS inclusion_probability, seq FROM latest"),
    "recorded_scores": _with("SELECT item_id, code_id, CASE WHEN code_id = 'toxic' THEN length(text) % 100 / 100.0::DOUBLE ELSE 0.75::DOUBLE END AS probability FROM items CROSS JOIN codes WHERE item_id IN (SELECT item_id FROM gold) AND text <> ''"),
    "csv_items": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, source, sha256('4:item' || strlen(t) || ':' || t) AS item_hash FROM (SELECT *, {_NORMAL} AS t FROM documents)",
    "tsv_items": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, source, sha256('4:item' || strlen(t) || ':' || t) AS item_hash FROM (SELECT *, {_NORMAL} AS t FROM documents)",
    "jsonl_items": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, source, sha256('4:item' || strlen(t) || ':' || t) AS item_hash FROM (SELECT *, {_NORMAL} AS t FROM documents)",
    "numbered_items": f"SELECT pos AS ord, 'row_' || lpad(CAST(pos AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') AS item_id, sha256('4:item' || strlen(t) || ':' || t) AS item_hash FROM (SELECT row_number() OVER () AS pos, count(*) OVER () AS n, {_NORMAL} AS t FROM documents)",
    "labelled_items": _with("SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM gold)"),
    "definitions": r"""
      SELECT 'item_' || item_id AS code_id, d AS norm_definition, sha256('4:code' || strlen(d) || ':' || d || '3:yes2:no') AS code_hash, length(text) // 4 + 1 AS n_tokens,
        len(list_filter(string_split(regexp_replace(d, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) > 2 OR length(d) > 400 AS advised
      FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS d FROM benchmark)""",
    "code_batches": _with("SELECT item_id, CASE WHEN base >= 2000 THEN 40 ELSE CAST(ceil(40.0 / greatest(1, least(2000 - base, 800) // 50)) AS BIGINT) END AS n_calls FROM (SELECT item_id, length(text) // 4 + 1 AS base FROM items)"),
    "gold_scores": _with("SELECT code_id, item_id, split, round(p, 6) AS p, label AS g, 1.0::DOUBLE / pi AS w FROM latest JOIN scores USING (item_id, code_id) JOIN items USING (item_id) WHERE coder = 'coder_1' AND lang <> 'de'"),
    "full_check": _with(
        """SELECT c.code_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_gold_positive, 0) AS n_gold_positive, coalesce(n_test, 0) AS n_test, round(t_lo, 6) AS t_lo, round(t_hi, 6) AS t_hi, round(coverage, 6) AS coverage, round(kappa, 6) AS kappa,
          coalesce(verdict, 'INSUFFICIENT_EVIDENCE') AS verdict, CASE WHEN n_gold IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE reason END AS reason, round(positive_risk, 6) AS positive_risk, round(negative_risk, 6) AS negative_risk, round(brier, 6) AS brier, round(ece, 6) AS ece,
          round(human_kappa, 6) AS human_kappa, round(human_alpha, 6) AS human_alpha,
          CASE WHEN verdict IN ('ok', 'weak') THEN NULL WHEN human_kappa < 0.7::DOUBLE THEN printf('%s: coders disagree (kappa %.2f); sharpen the definition first', c.code_id, human_kappa)
            WHEN n_gold IS NULL THEN c.code_id || ': no scored gold label yet'
            WHEN reason = 'INSUFFICIENT_EVIDENCE' THEN printf('%s: too few positives among the gold labels (%d for fitting, %d held out)', c.code_id, n_gold_positive, n_test_positive)
            WHEN reason = 'NO_VALID_THRESHOLD' THEN c.code_id || ': no band keeps both classes'' errors within alpha; at least 17 accepted items of each class are needed'
            ELSE printf('%s: held-out kappa %.2f is below the bar', c.code_id, kappa) END AS advice
        FROM (SELECT code_id FROM codes UNION ALL SELECT 'unjudged') c LEFT JOIN certified USING (code_id) LEFT JOIN risk USING (code_id) LEFT JOIN brier USING (code_id) LEFT JOIN ece USING (code_id) LEFT JOIN ceiling USING (code_id)""",
        "judged AS (SELECT code_id, item_id, split, p, label AS g, 1.0::DOUBLE / pi AS w FROM latest JOIN scores USING (item_id, code_id) WHERE coder = 'coder_1')",
        *_certified("judged"),
        f"risk AS (SELECT code_id, sum(w * wrong) FILTER (WHERE g = 1) / sum(w) FILTER (WHERE g = 1) AS positive_risk, sum(w * wrong) FILTER (WHERE g = 0) / sum(w) FILTER (WHERE g = 0) AS negative_risk FROM (SELECT j.code_id, g, w, CASE WHEN ({_DEC}) <> g THEN 1.0::DOUBLE ELSE 0 END AS wrong FROM judged j JOIN certified b ON j.code_id = b.code_id WHERE split = 'test' AND {_ACC}) GROUP BY code_id)",
        "brier AS (SELECT code_id, sum(w * (p - g) * (p - g)) / sum(w) AS brier FROM judged WHERE split = 'test' GROUP BY code_id)",
        "ece AS (SELECT code_id, sum(gap) / sum(weight) AS ece FROM (SELECT code_id, sum(w) AS weight, abs(sum(p * w) - sum(g * w)) AS gap FROM judged WHERE split = 'test' GROUP BY code_id, greatest(0, least(9, floor(p * 10)))) GROUP BY code_id)",
        f"ceiling AS (SELECT code_id, {KAPPA} AS human_kappa, {ALPHA} AS human_alpha FROM (SELECT code_id, {_cells('s', '1.0::DOUBLE', 'f')} FROM ({_PAIRS}) GROUP BY code_id))",
    ),
    "check_summary": _with("SELECT gold_n, double_coded, exact, round(delta_share, 6) AS delta_share FROM (SELECT count(DISTINCT item_id) AS gold_n, count(DISTINCT item_id) FILTER (WHERE coder <> (SELECT coder FROM records GROUP BY coder ORDER BY count(*) DESC, coder DESC LIMIT 1)) AS double_coded FROM records), (SELECT bool_and(exact) AS exact, max(delta_share) AS delta_share FROM certified)", *_CERTIFIED),
    "certified_decisions": _with(f"""SELECT item_id, code_id, CASE WHEN usable THEN {_DEC} END AS label, p AS probability, CASE WHEN NOT usable THEN 'not_automatable' WHEN ({_DEC}) IS NULL THEN 'abstain_unreviewed' ELSE 'auto' END AS source
      FROM scores LEFT JOIN (SELECT code_id, t_lo, t_hi, verdict IN ('ok', 'weak') AND t_hi IS NOT NULL AS usable FROM certified) USING (code_id)""", *_CERTIFIED),
    "streamed_decisions": _with(f"""SELECT item_id, code_id, p AS probability, {_DEC} AS label, CASE WHEN t_hi IS NULL THEN 'not_automatable' WHEN ({_DEC}) IS NULL THEN 'abstain_unreviewed' ELSE 'auto' END AS source
      FROM scores LEFT JOIN (VALUES ('toxic', 0.40::DOUBLE, 0.60::DOUBLE)) AS v(code_id, t_lo, t_hi) USING (code_id)"""),
    "certified_risk": _with(f"SELECT code_id, round(sum(wrong) FILTER (WHERE g = 1) / count(*) FILTER (WHERE g = 1), 6) AS positive_risk, round(sum(wrong) FILTER (WHERE g = 0) / count(*) FILTER (WHERE g = 0), 6) AS negative_risk FROM (SELECT e.code_id, g, CASE WHEN ({_DEC}) <> g THEN 1.0::DOUBLE ELSE 0 END AS wrong FROM even e JOIN certified b ON e.code_id = b.code_id WHERE split = 'test' AND {_ACC}) GROUP BY code_id", *_CERTIFIED),
    "comparison_kappas": _with("SELECT 'sharp' AS backend, 1.5::DOUBLE AS cost, code_id, round(kappa, 6) AS kappa FROM certified UNION ALL SELECT 'blunt', NULL, code_id, NULL FROM certified", *_CERTIFIED),
    "human_interval": _with(
        f"SELECT code_id, round(quantile_cont(kappa, 0.025::DOUBLE), 6) AS human_lo, round(quantile_cont(kappa, 0.975::DOUBLE), 6) AS human_hi FROM (SELECT code_id, rep, {KAPPA} AS kappa FROM (SELECT x.code_id, rep, {_cells('d', '1.0::DOUBLE')} FROM picks x JOIN n USING (code_id, g, slot) GROUP BY x.code_id, rep)) GROUP BY code_id".replace("FILTER (WHERE g =", "FILTER (WHERE x.g ="),
        f"pairs AS ({_PAIRS})",
        "n AS (SELECT code_id, f AS g, s AS d, row_number() OVER (PARTITION BY code_id, f ORDER BY item_id) - 1 AS slot, count(*) OVER (PARTITION BY code_id, f) AS size FROM pairs)",
        "picks AS (SELECT code_id, g, rep, CAST('0x' || substr(sha256('42:' || rep || ':' || g || ':' || slot), 1, 8) AS BIGINT) % size AS slot FROM n CROSS JOIN (SELECT range AS rep FROM range(0, 2000)))",
    ),
    "gold_plan": _with(
        "SELECT item_id, split, 'uniform' AS stratum, take / size::DOUBLE AS inclusion_probability FROM drawn WHERE rank <= take",
        "drawn AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('7:' || split || ':uniform:' || item_id)) AS rank, count(*) OVER (PARTITION BY split) AS size, CASE split WHEN 'calibration' THEN 54 ELSE 67 END AS take FROM splits WHERE split <> 'dev')",
    ),
    "enrich_round": _with(
        "SELECT item_id, 'calibration' AS split, 'enriched' AS stratum, round(least(1, base + (1 - base) * least(40, n) / n), 6) AS inclusion_probability FROM rest, (SELECT count(*) AS n FROM rest), (SELECT least(0.99::DOUBLE, 60.0::DOUBLE / count(*)) AS base FROM splits WHERE split = 'calibration') ORDER BY sha256('7:calibration:enriched:toxic:' || item_id) LIMIT 40",
        _POOL, _UNIFORM, "rest AS (SELECT item_id FROM pool WHERE item_id NOT IN (SELECT item_id FROM uniform))",
    ),
    "curve_table": _with(f"SELECT code_id, band_id, round(coalesce(sum(w) FILTER (WHERE {_ACC}), 0) / sum(w), 6) AS coverage FROM gs CROSS JOIN grid WHERE split = 'test' AND band_id % 2 = 0 GROUP BY code_id, band_id"),
    "logprob_probabilities": _with("SELECT item_id, code_id, round(least(1, exp(ln(p) + 0.05::DOUBLE)), 6) AS probability FROM scores"),
    "valid_probabilities": _with("SELECT item_id, code_id, round(p, 6) AS probability FROM scores"),
    "distinct_texts": _with(f"SELECT {_HASH} AS text_hash, max(length(text)) AS n_chars, count(*) AS n_units FROM items GROUP BY text"),
    "pooled_scores": "SELECT CAST(conv_id AS VARCHAR) AS item_id, 'toxic' AS code_id, round(max(p), 6) AS largest, round(avg(p), 6) AS mean FROM (SELECT conv_id, CASE WHEN length(text) % 5 <> 0 THEN length(text) % 100 / 100.0::DOUBLE END AS p FROM conversations) GROUP BY conv_id",
    "run_scores": _with("SELECT item_id, code_id, round(probability, 6) AS probability FROM ran", *_RAN),
    "run_failures": _with("SELECT DISTINCT item_id FROM ran WHERE probability IS NULL", *_RAN),
    "run_cache": _with("SELECT round(probability, 6) AS probability, count(DISTINCT code_id || ':' || text) AS n FROM (SELECT * FROM ran UNION ALL SELECT '', code_id, t, 0.5 FROM early CROSS JOIN codes) WHERE probability IS NOT NULL GROUP BY probability", *_RAN),
    "cache_hits": _with("SELECT count(*) AS lookups, count(cached) AS hits, count(*) - count(cached) AS misses, round(count(cached) / count(*)::DOUBLE, 6) AS hit_rate FROM looked", *_LOOKED),
    "cache_misses": _with("SELECT item_id, code_id, key FROM looked WHERE cached IS NULL", *_LOOKED),
    "run_cost": _with("SELECT calls, input_tokens, output_tokens, n_codes, round(cost, 6) AS cost, cost > 5 AS confirm FROM (SELECT *, (input_tokens * 0.15::DOUBLE + output_tokens * 0.60::DOUBLE) / 1000000 AS cost FROM (SELECT count(*) AS calls, CAST(sum(length(text) // 4 + 1) + 50 * count(*) AS BIGINT) AS input_tokens, 32 * count(*) AS output_tokens, 2 AS n_codes FROM items))"),
    "backend_comparison": _with("SELECT 'sharp' AS backend, count(*) FILTER (WHERE verdict IN ('ok', 'weak')) AS usable, round(coalesce(1 - min(coverage) FILTER (WHERE verdict IN ('ok', 'weak')), 1), 6) AS share FROM certified UNION ALL SELECT 'blunt', 0, 1.0::DOUBLE", *_CERTIFIED),
    "review_share": _with("SELECT round(coalesce(1 - min(coverage), 1), 6) AS share FROM certified WHERE verdict IN ('ok', 'weak')", *_CERTIFIED),
    "replayed": _with(f"SELECT item_id, code_id, CASE WHEN code_id = 'toxic' AND {_HASH} IN (SELECT {_HASH} FROM items WHERE item_id IN (SELECT item_id FROM gold)) THEN 0.25::DOUBLE END AS probability FROM items CROSS JOIN codes"),
}
