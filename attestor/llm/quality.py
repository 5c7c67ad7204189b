"""Quality rules with adaptive thresholds, in DataFrame functions only.

Four measures of each document are summed into mergeable quantile sketches per language and source:
counts over buckets of bounded relative width (1/32), so that any two sketches merge by adding counts and
a quantile is off by one bucket at most. Fences a multiple of the middle spread outside the quartiles
replace fixed cutoffs; a group of too few documents takes its language's merged sketch, or the whole
corpus's. Documents are joined to their group's fences and filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

#: Least spread between quartile and fence by measure: tight groups must not reject ordinary documents.
MEASURES = {"word_length": 300, "symbols": 150, "dup_lines": 300, "repeats": 150}
TWO_SIDED = ("word_length",)
SPREADS, SUPPORT = 5, 50
#: Parts that each group's documents are dealt into for the join with its fences: one source may hold most rows.
SALTS = 64
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACE = "\\t\\n\\u000B\\u000C\\r"
_WORDS = f"array_remove(split(translate(body, '{_SPACE}', '     '), ' ', -1), '')"
_GRAM = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
_HASHES = f"IF(size(w) >= {WINDOW}, transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({_GRAM})), array())"
# equal hashes are only a hint; the windows themselves are compared
_REPEATED = f"""
transform(array(array_sort(transform(sequence(0, size(w) - {WINDOW}), i -> struct(concat_ws(' ', {_GRAM}) AS g, i AS i)))), s ->
  aggregate(
    array_sort(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[j - 1].g = s[j].g) OR (j < size(s) - 1 AND s[j + 1].g = s[j].g)), j -> s[j].i)),
    struct(0 AS total, 0 AS past),
    (a, p) -> struct(a.total + p + {WINDOW} - greatest(p, a.past) AS total, p + {WINDOW} AS past),
    a -> a.total))[0]"""
_LINES = f"filter(split(body, '\\n', -1), x -> translate(x, ' {_SPACE}', '') <> '')"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), lang, source, the base counts and base_failed of every row of docs; null text has no words."""
    at = docs.columns
    keep = [F.col(c) if c in at else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("body"))
    split = rows.selectExpr("*", f"{_WORDS} AS w", f"{_LINES} AS lines")
    hashed = split.selectExpr(
        "doc_id", "xxhash64(body) AS tkey", "lang", "source", "w", f"{_HASHES} AS hashes",
        f"CAST(length(translate(body, ' {_SPACE}', '')) AS LONG) AS word_chars",
        "CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS LONG) AS n_symbols",
        "CAST(size(lines) AS LONG) AS n_lines",
        "CAST(size(lines) - size(array_distinct(lines)) AS LONG) AS n_dup_lines",
    )
    counted = hashed.selectExpr(
        "doc_id", "tkey", "lang", "source", "CAST(size(w) AS LONG) AS n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        f"CAST(CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN {_REPEATED} ELSE 0 END AS LONG) AS n_repeat_words",
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def values() -> dict[str, str]:
    return {
        "word_length": "word_chars * 100 div n_words",
        "symbols": "n_symbols * 1000 div n_words",
        "dup_lines": "n_dup_lines * 1000 div n_lines",
        "repeats": "n_repeat_words * 1000 div n_words",
    }


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n over the documents that pass the base rules; add n to merge."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in values().items())
    long = measured.where("NOT base_failed").selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", f"stack({len(MEASURES)}, {pairs}) AS (measure, v)")
    shift = "greatest(0, length(bin(v)) - 6)"
    return long.selectExpr("lang", "source", "measure", f"shiftleft(shiftright(v, {shift}), {shift}) AS bucket").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("support"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and low_/high_ fences of every measure, from the most special sketch with enough support."""
    sketch = runtime.written(sketch, "sketches")
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).withColumnsRenamed({"q1": "l1", "q3": "l3", "support": "ls"})
    every = _quartiles(sketch, []).withColumnsRenamed({"q1": "e1", "q3": "e3"}).drop("support")
    picked = own.join(lang, ["lang", "measure"]).join(every, "measure")
    pick = lambda a, b, c: F.when(F.col("support") >= SUPPORT, F.col(a)).when(F.col("ls") >= SUPPORT, F.col(b)).otherwise(F.col(c))
    sized = picked.select("lang", "source", "measure", pick("q1", "l1", "e1").alias("q1"), pick("q3", "l3", "e3").alias("q3"))
    sized = sized.withColumn("spread", F.greatest(SPREADS * (F.col("q3") - F.col("q1")), F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])[F.col("measure")]))
    of = lambda m, e: F.max(F.when(F.col("measure") == m, e))
    columns = [of(m, F.col("q3") + F.col("spread")).alias(f"high_{m}") for m in MEASURES]
    columns += [of(m, F.col("q1") - F.col("spread")).alias(f"low_{m}") for m in TWO_SIDED]
    return sized.groupBy("lang", "source").agg(*columns)


def _judged(docs: DataFrame) -> DataFrame:
    """The columns of `judge` besides tkey, lang and source (nulls as empty), on which the verdict depends."""
    measured = runtime.written(measures(docs), "measures")
    of = {m: F.expr(v) for m, v in values().items()}
    inside = F.lit(True)
    for m, v in of.items():
        inside = inside & (v <= F.col(f"high_{m}"))
        if m in TWO_SIDED:
            inside = inside & (v >= F.col(f"low_{m}"))
    keyed = measured.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    salted = fences(sketches(measured)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(salted, ["lang", "source", "salt"], "left")
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select("doc_id", "tkey", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    kept is false for a base failure and outside the fences of the row's language and source. Null and
    empty texts fail the base; null languages and sources form groups of their own; columns `lang` and
    `source` may be missing. Repeated rows give a row each.
    """
    return _judged(docs).drop("tkey", "lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that were kept, each judged by itself: rows that share an id are told apart by text, language and source."""
    bad = _judged(docs).where("NOT kept").select(F.col("doc_id").alias("bad_doc"), "tkey", F.col("lang").alias("bad_lang"), F.col("source").alias("bad_source")).distinct()
    of = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    same = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["tkey"])
    return docs.join(bad, same & (of("lang") == bad["bad_lang"]) & (of("source") == bad["bad_source"]), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(runtime.table(spark, sf_dir, "documents"))
