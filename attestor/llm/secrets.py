"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are strong by themselves. Parts that prove little alone (a short or loosely named secret, a
login name, a long opaque token) are weak candidates with a role; an interval join over bins of `reach`
code points reports one only if a part of another role (identifier, secret, endpoint) stands within
`reach` of it in the same document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

REACH = 200
#: Matches whose positions are summed up together.
RUN = 500
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "weak")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LOOSE = r"""((?i:\b(?:pwd|pass|auth|key|credentials?|private_?key|access_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
LOGIN = r"""((?i:\b(?:user(?:name)?|login|account|client_?id)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[^\x00-\x20"'<>]+"""
OPAQUE = r"[A-Za-z0-9+/]{40,}={0,2}"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _found(pattern: str, kind: str, when: str, value: int = 0, least: int = 0, most: int = 1 << 30) -> str:
    """Array of struct(start, past, kind): matches whose group `value` has `least` to `most` characters.

    The text between matches and the matches themselves, laid end to end, give the positions.
    """
    p = _quoted(pattern)
    # positions are summed up in runs of bounded length, as adding to an array copies it
    step = f"""struct(a.at + length(x.`0`) + length(x.`1`) AS at,
                   concat(a.s, array(struct(a.at + length(x.`0`) AS start, a.at + length(x.`0`) + length(x.`1`) AS past, '{kind}' AS kind, length(x.`2`) AS size))) AS s)"""
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, past: INT, kind: STRING, size: INT> >)"
    spans = f"""
    filter(
      transform(array(arrays_zip(slice(split(body, {p}, -1), 1, size(regexp_extract_all(body, {p}, 0))), regexp_extract_all(body, {p}, 0), regexp_extract_all(body, {p}, {value}))), m ->
        aggregate(
          sequence(0, size(m) div {RUN}),
          struct(0 AS at, array({empty}) AS runs),
          (all, k) -> transform(array(aggregate(slice(m, k * {RUN} + 1, {RUN}), struct(all.at AS at, {empty} AS s), (a, x) -> {step})), r ->
            struct(r.at AS at, concat(all.runs, array(r.s)) AS runs))[0],
          all -> flatten(all.runs)))[0],
      x -> x.size >= {least} AND x.size <= {most})"""
    none = "CAST(array() AS ARRAY<STRUCT<start: INT, past: INT, kind: STRING> >)"
    return f"CASE WHEN {when} THEN transform({spans}, x -> struct(x.start AS start, x.past AS past, x.kind AS kind)) ELSE {none} END"


def _joined(spans: str) -> str:
    order = "transform({s}, x -> struct(x.start AS start, array_position(array({k}), x.kind) AS rank, x.past AS past, x.kind AS kind))"
    order = order.format(s=spans, k=", ".join(f"'{k}'" for k in KINDS))
    return f"array_join(transform(array_sort({order}), x -> concat(x.kind, ':', x.start, ':', x.past)), ',')"


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, base, weak and support arrays of every row; text itself is left behind."""
    assigns = "(contains(body, '=') OR contains(body, ':'))"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).selectExpr("*", f"{assigns} AND rlike(body, {_quoted(ASSIGN)}) AS has_assign", "contains(body, 'AKIA') AS has_access", f"rlike(body, {_quoted(HEX)}) AS has_hex", f"rlike(body, {_quoted(OPAQUE)}) AS has_opaque", f"{assigns} AS has_sign")
    return rows.selectExpr(
        "doc_id", "xxhash64(body) AS key",
        f"{_found(ASSIGN, 'assign', 'has_assign', 2, 12)} AS assigned",
        f"{_found(ACCESS, 'access', 'has_access', 0, 18)} AS accesses",
        f"{_found(HEX, 'hex', 'has_hex')} AS hexes",
        f"concat({_found(ASSIGN, 'secret', 'has_assign', 2, 1, 11)}, {_found(LOOSE, 'secret', 'has_sign', 2)}, {_found(OPAQUE, 'secret', 'has_opaque')}, {_found(LOGIN, 'login', 'has_sign', 2)}) AS weak",
        f"{_found(ENDPOINT, 'endpoint', 'has_sign')} AS endpoints",
    )


def linked(parted: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, key, more: the weak spans that a part of another role stands near."""
    role = "CASE kind WHEN 'access' THEN 'ident' WHEN 'login' THEN 'ident' WHEN 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role"
    some = parted.where("size(weak) > 0")
    weak = some.selectExpr("doc_id", "key", "explode(weak) AS x").selectExpr("doc_id", "key", "x.start AS start", "x.past AS past", "x.kind AS kind", f"explode(sequence(x.start div {reach}, x.past div {reach})) AS bin").selectExpr("*", role)
    held = some.selectExpr("doc_id AS d", "key AS k", "explode(concat(assigned, accesses, hexes, weak, endpoints)) AS y")
    held = held.selectExpr("d", "k", "y.start AS s", "y.past AS p", "y.kind AS kind", f"explode(sequence(greatest(0, y.start - {reach}) div {reach}, (y.past + {reach}) div {reach})) AS b").selectExpr("d", "k", "s", "p", "b", role.replace("AS role", "AS other")).distinct()
    near = weak["doc_id"].eqNullSafe(held["d"]) & (weak["key"] == held["k"]) & (weak["bin"] == held["b"]) & (weak["role"] != held["other"]) & (held["s"] < weak["past"] + reach) & (held["p"] > weak["start"] - reach)
    met = weak.join(held, near, "left_semi").selectExpr("doc_id", "key", "struct(start, past, 'weak' AS kind) AS x").distinct()
    return met.groupBy("doc_id", "key").agg(F.collect_list("x").alias("more"))


def scan(docs: DataFrame, *, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:past in code points) and found, the spans as an array.

    Null and empty texts have no spans. Every row gives one row; rows equal in id and text give equal
    results. A weak span inside or across a base span stays separate.
    """
    parted = runtime.written(parts(docs), "parts")
    more = linked(parted, reach).withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = parted.join(more, parted["doc_id"].eqNullSafe(more["d"]) & (parted["key"] == more["k"]), "left")
    base = "concat(assigned, accesses, hexes)"
    everything = f"concat({base}, coalesce(more, array()))"
    return joined.selectExpr(
        "doc_id", "CAST(size(assigned) AS LONG) AS n_assign", "CAST(size(accesses) AS LONG) AS n_access", "CAST(size(hexes) AS LONG) AS n_hex",
        f"sha2({_joined(base)}, 256) AS base_sha256", f"{_joined(everything)} AS spans", f"{everything} AS found", "key",
    )


def redact(docs: DataFrame, *, mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every reported span of text replaced by `mask`, columns as before; overlapping spans are replaced together.

    Rows without spans, null and empty texts among them, stay as they are. Rows that share an id are told apart by their texts.
    """
    key, doc, hit, found = runtime.fresh(docs, "text_key", "hit_doc", "hit_key", "hit_spans")
    hits = scan(docs.select("doc_id", "text"), reach=reach).where("size(found) > 0").select(F.col("doc_id").alias(doc), F.col("key").alias(hit), F.col("found").alias(found)).dropDuplicates([doc, hit])
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(hit)), "left")
    # spans that touch or overlap become one; pieces of text and masks are laid end to end once
    united = f"""
    aggregate(array_sort({found}), CAST(array() AS ARRAY<STRUCT<start: INT, past: INT> >),
      (a, x) -> CASE WHEN size(a) > 0 AND x.start < a[size(a) - 1].past
                     THEN concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start AS start, greatest(a[size(a) - 1].past, x.past) AS past)))
                     ELSE concat(a, array(struct(x.start AS start, x.past AS past))) END)"""
    rebuilt = f"""
    transform(array({united}), u -> concat(
      array_join(transform(u, (x, i) -> concat(substring(text, IF(i = 0, 0, u[i - 1].past) + 1, x.start - IF(i = 0, 0, u[i - 1].past)), '{mask}')), ''),
      substring(text, u[size(u) - 1].past + 1)))[0]"""
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(F.expr(rebuilt))).select(docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(runtime.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
