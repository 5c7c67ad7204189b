"""Registered queries of the coding engine, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import hashing, stats
from .operators import coding, drift, gold, sampling, scoring, selective, splits, thresholds, units
from .plans import check, demo, report
from .queries_sql import SQL
from .sources import corpus, files, scratch, settings, stores
from .streaming import coder

ALPHA = 0.20


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded alike on both sides."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cal(gs: DataFrame) -> DataFrame:
    return gs.where(F.col("split") == splits.CALIBRATION)


def _test(gs: DataFrame) -> DataFrame:
    return gs.where(F.col("split") == splits.TEST)


def certify(spark, sf):
    return _r(check.certify(demo.even(spark, sf), alpha=ALPHA)).select("code_id", "n_gold", "n_gold_positive", "t_lo", "t_hi", "coverage", "n_test", "n_test_positive", "kappa", "verdict", "reason")


def split_assignment(spark, sf):
    return demo.splits(spark, sf).select("item_id", "split_key", "rn", "split")


def split_counts(spark, sf):
    return splits.split_counts(demo.splits(spark, sf))


def split_violations(spark, sf):
    ids = demo.labels(spark, sf).select("item_id").distinct()
    return splits.outside(ids, demo.splits(spark, sf), splits.CALIBRATION).select("item_id", "split")


def item_hashes(spark, sf):
    t = hashing.normalise_text(F.col("text"))
    return demo.items(spark, sf).select("item_id", F.length(t).cast("long").alias("n_chars"), hashing.item_hash(t).alias("item_hash"), hashing.estimate_tokens(t).alias("n_tokens"))


def corpus_digest(spark, sf):
    return hashing.corpus_hash(demo.items(spark, sf).select(hashing.item_hash(F.col("text")).alias("item_hash")))


def length_stats(spark, sf):
    return _r(corpus.length_stats(demo.items(spark, sf)))


def confusion(spark, sf):
    gs = demo.weighted(spark, sf)
    made = gs.groupBy("code_id").agg(F.count("*").alias("n"), *stats.cells(F.col("g"), F.when(F.col("p") >= 0.5, 1).otherwise(0), F.col("w")))
    return _r(made.select("code_id", "n", "a", "b", "c", "d", stats.observed_agreement().alias("agreement"), stats.kappa().alias("kappa"), stats.kappa_reason().alias("kappa_reason"), stats.krippendorff().alias("alpha")))


def effective_sizes(spark, sf):
    gs = demo.weighted(spark, sf)
    return _r(gs.groupBy("code_id", "g").agg(stats.weighted_mean(F.col("p"), F.col("w")).alias("mean_p"), stats.effective_size(F.col("w")).alias("n_eff")))


def brier(spark, sf):
    return _r(stats.brier(demo.weighted(spark, sf), "code_id"))


def reliability(spark, sf):
    return _r(stats.reliability(demo.weighted(spark, sf), "code_id"))


def calibration_error(spark, sf):
    return _r(stats.calibration_error(demo.weighted(spark, sf), "code_id"))


def band_grid(spark, sf):
    return _r(thresholds.grid(spark))


def band_candidates(spark, sf):
    return _r(thresholds.candidates(_cal(demo.weighted(spark, sf)), alpha=ALPHA)).select("code_id", "band_id", "coverage", "n_accepted", "pos_n", "neg_n", "pos_eff", "neg_eff", "pos_risk", "neg_risk", "pos_p", "neg_p", "delta_share", "valid")


def band_fit(spark, sf):
    return _r(thresholds.fit(_cal(demo.weighted(spark, sf)), alpha=ALPHA)).drop("delta_share")


def evidence_shortfall(spark, sf):
    return thresholds.shortfall(thresholds.candidates(_cal(demo.even(spark, sf)), alpha=0.02), alpha=0.02)


def realised_risk(spark, sf):
    bands = spark.createDataFrame([(c, 0.40, 0.60) for c in demo.CODE_IDS], "code_id string, t_lo double, t_hi double")
    return _r(thresholds.realised_risk(_test(demo.weighted(spark, sf)), bands))


def selective_curve(spark, sf):
    return _r(selective.selective_curve(_test(demo.weighted(spark, sf))).drop("t_lo"))


def labour_curve(spark, sf):
    return _r(selective.labour_curve(_test(demo.weighted(spark, sf)), labour_offset=0.05).drop("t_lo"))


def _fractions(spark):
    return spark.createDataFrame([(c, k, k / 4) for c in demo.CODE_IDS for k in range(5)], "code_id string, point int, fraction double")


def random_baseline(spark, sf):
    return _r(selective.random_baseline(_test(demo.even(spark, sf)), _fractions(spark)))


def bootstrap_interval(spark, sf):
    rows = _test(demo.even(spark, sf)).select("code_id", "item_id", F.col("g"), F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("d"), "w")
    return _r(selective.bootstrap(rows))


def most_informative(spark, sf):
    test = _test(demo.even(spark, sf))
    curve = selective.labour_curve(test).select("code_id", "point", "kappa")
    return _r(selective.most_informative(curve, selective.random_baseline(test, _fractions(spark))))


def gold_latest(spark, sf):
    return gold.gold_latest(demo.gold_log(spark, sf)).select("item_id", "code_id", "coder", "label", "seq")


def primary_coder(spark, sf):
    return gold.primary_coder(demo.gold_log(spark, sf))


def coded_pairs(spark, sf):
    return gold.coded_pairs(demo.gold_log(spark, sf), "coder_2")


def gold_labels(spark, sf):
    return gold.labels_for(demo.gold_log(spark, sf), split="test", coder="coder_1").select("code_id", "item_id", "g", "w")


def double_coded(spark, sf):
    return gold.double_coded(demo.gold_log(spark, sf))


def human_ceiling(spark, sf):
    return _r(check.human_ceiling(demo.gold_log(spark, sf)))


def human_labels(spark, sf):
    log = demo.gold_log(spark, sf)
    review = log.where("coder = 'coder_2' AND label = 0").select("item_id", "code_id", F.lit(1).alias("label"), "seq")
    return gold.human_labels(log, review)


def gold_summary(spark, sf):
    log = demo.gold_log(spark, sf)
    return log.crossJoin(F.broadcast(gold.primary_coder(log).withColumnRenamed("coder", "main"))).agg(F.count_distinct("item_id").alias("gold_n"), F.count_distinct(F.when(F.col("coder") != F.col("main"), F.col("item_id"))).alias("double_coded"))


def plan_uniform(spark, sf):
    return sampling.plan_uniform(splits.of_split(demo.splits(spark, sf), "calibration"), 60, split="calibration", seed=7)


def enrichment_pool(spark, sf):
    p = demo.scores(spark, sf).where("code_id = 'toxic'").select("item_id", F.col("probability").alias("p"))
    return sampling.enrichment_pool(p)


def plan_enriched(spark, sf):
    return sampling.plan_enriched(enrichment_pool(spark, sf), plan_uniform(spark, sf), 40, split="calibration", seed=7, base_inclusion=0.1, code_id="toxic")


def plan_overlap(spark, sf):
    return sampling.plan_overlap(plan_uniform(spark, sf), 15, seed=7)


def _bands(spark):
    return spark.createDataFrame([("toxic", 0.40, 0.60, "ok"), ("high_quality", None, None, "NOT_AUTOMATABLE")], "code_id string, t_lo double, t_hi double, verdict string")


def _decisions(spark, sf):
    """The second coder's positive judgements stand for reviews; the scorer does not serve German."""
    human = demo.gold_log(spark, sf).where("coder = 'coder_2' AND label = 1").select("item_id", "code_id", "label")
    served = demo.table(spark, sf, "documents").where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("item_id"))
    p = demo.scores(spark, sf).join(served, "item_id", "left_semi")
    return coding.apply_bands(demo.ids(spark, sf), demo.codes(spark), _bands(spark), p, human)


def decisions(spark, sf):
    return _decisions(spark, sf)


def decision_sources(spark, sf):
    return coding.counts_by_source(_decisions(spark, sf))


def decision_coverage(spark, sf):
    return _r(coding.coverage(_decisions(spark, sf)))


def coded_table(spark, sf):
    return coding.coded_table(demo.items(spark, sf).drop("text"), _decisions(spark, sf), list(demo.CODE_IDS))


def abstentions(spark, sf):
    return coding.abstentions(_decisions(spark, sf), demo.items(spark, sf))


def review_queue(spark, sf):
    done = demo.gold_log(spark, sf).where("coder = 'coder_2'").select("item_id", "code_id").distinct()
    return coding.review_queue(_decisions(spark, sf), done, 25)


def code_drift(spark, sf):
    """Benchmark texts as definitions: since calibration the short ones came, the long ones went, those that say `en` changed."""
    t = demo.table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), "item_id").alias("code_id"), "text")
    live = t.where("length(text) < 300").select("code_id", hashing.sha_parts(F.lit("code"), F.col("text")).alias("code_hash"))
    then = t.where("length(text) >= 150").select("code_id", hashing.sha_parts(F.lit("code"), F.regexp_replace("text", "en", "")).alias("code_hash"))
    return drift.code_drift(live, then)


def distinct_texts(spark, sf):
    u = demo.items(spark, sf).select("item_id", F.lit(0).alias("unit_index"), "text", hashing.item_hash(F.col("text")).alias("text_hash"))
    return units.distinct_texts(u).select("text_hash", F.length("text").cast("long").alias("n_chars"), "n_units")


def passages(spark, sf):
    """Passages of at most 4,000 characters; those after the first open with the last 80 of the one before."""
    return units.build_units(demo.items(spark, sf), max_tokens=1000, overlap_tokens=20).select("item_id", "unit_index", F.length("text").cast("long").alias("n_chars"), "text_hash")


def pooled_scores(spark, sf):
    turns = demo.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), F.lit("toxic").alias("code_id"), (F.when(F.length("text") % 5 != 0, F.length("text") % 100 / 100.0)).alias("probability"))
    return _r(units.pool_scores(turns, "max").withColumnRenamed("probability", "largest").join(units.pool_scores(turns, "mean").withColumnRenamed("probability", "mean"), ["item_id", "code_id"]))


def _looked(spark, sf):
    """All items against a cache that an earlier run over the English texts has filled."""
    u = demo.items(spark, sf).select("item_id", F.lit(0).alias("unit_index"), "text", hashing.item_hash(F.col("text")).alias("text_hash"), "lang")
    c = spark.createDataFrame([("toxic", "c1"), ("high_quality", "c2")], "code_id string, code_hash string")
    empty = spark.createDataFrame([], scoring.CACHE_SCHEMA)
    earlier = scoring.lookups(u.where("lang = 'en'").drop("lang"), c, empty, "recorded", "v1")
    keys = earlier.select("key", F.lit(0.5).alias("probability"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(0).cast("long").alias("input_tokens")).dropDuplicates(["key"])
    return scoring.lookups(u.drop("lang"), c, keys, "recorded", "v1")


def _by_length(text: str, code_id: str) -> float | None:
    """A scorer that any engine reproduces; it fails on every tenth length for one code."""
    return None if code_id == "toxic" and len(text) % 10 == 0 else len(text) % 100 / 100


def _codes(spark):
    return spark.createDataFrame([(i, i, i, None, None) for i in demo.CODE_IDS], "code_id string, code_hash string, definition string, examples_yes array<string>, examples_no array<string>")


def _run(spark, sf) -> scoring.Run:
    """Scoring of all items, whole, against the cache of an earlier run over the English texts."""
    c = _codes(spark)
    items, scorer = demo.items(spark, sf), scoring.CallableBackend(function=_by_length)
    u = items.where("lang = 'en'").select(hashing.item_hash(F.col("text")).alias("text_hash")).distinct()
    keys = scoring.lookups(u, c, spark.createDataFrame([], scoring.CACHE_SCHEMA), scorer.name, scorer.model_version)
    cache = keys.select("key", F.lit(0.5).alias("probability"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(0).cast("long").alias("input_tokens"))
    return scoring.run(spark, items, c, scorer, cache, written=scratch.written, max_tokens=1 << 28)


def run_scores(spark, sf):
    return _r(_run(spark, sf).scores.select("item_id", "code_id", "probability"))


def run_failures(spark, sf):
    return _run(spark, sf).failures


def run_cache(spark, sf):
    """What the cache holds after the run."""
    return _r(_run(spark, sf).cache.groupBy("probability").agg(F.count("*").alias("n")))


def cache_hits(spark, sf):
    return _r(scoring.cache_stats(_looked(spark, sf)))


def cache_misses(spark, sf):
    return _looked(spark, sf).where("cached is null").select("item_id", "code_id", "key")


def run_cost(spark, sf):
    u = demo.items(spark, sf).select("text")
    return _r(drift.needs_confirmation(drift.estimate_cost(u, 2, 50, 0.15, 0.60)))


def run_usage(spark, sf):
    """What the run looked up, found in the cache, sent and failed on."""
    done = _run(spark, sf)
    return _r(done.stats.crossJoin(done.usage))


def retried_scores(spark, sf):
    """The failed items scored again by a scorer that answers, laid over the first run."""
    done, c = _run(spark, sf), _codes(spark)
    items = corpus.subset(demo.items(spark, sf), done.failures)
    scorer = scoring.CallableBackend(function=lambda text, code: len(text) % 100 / 100)
    again = scoring.run(spark, items, c, scorer, done.cache, written=scratch.written, max_tokens=1 << 28)
    return _r(scoring.merged(done.scores, again.scores))


def saved_run(spark, sf):
    """Runs of three purposes saved one after another; the newest one that scored the corpus is read back."""
    where, scores = f"{scratch.root(spark)}/runs-{stores.new_run_id()}", demo.scores(spark, sf)
    for purpose, p in (("run", F.lit(0.5)), ("run", F.col("probability")), ("check", F.lit(0.25))):
        stores.save_run(scores.withColumn("probability", p), scoring.failed(scores), where, {"run_id": stores.new_run_id(), "purpose": purpose})
    return _r(spark.read.parquet(f"{stores.latest_run(spark, where, 'run')}/scores"))


def saved_splits(spark, sf):
    """The frozen assignment, written with its note and read back for the same corpus."""
    where = f"{scratch.root(spark)}/splits-{stores.new_run_id()}"
    stores.save_splits(demo.splits(spark, sf), where, seed=42, corpus_hash="x", fractions={})
    found, note = stores.load_splits(spark, where)
    stores.require_corpus(note, "x")
    return found.groupBy("split").agg(F.count("*").alias("n")).join(F.broadcast(spark.createDataFrame(list(note["counts"].items()), "split string, noted long")), "split")


def gold_log_read(spark, sf):
    """The gold log appended as JSON lines and read back, last judgements only."""
    log = stores.gold_log(spark, f"{scratch.root(spark)}/gold-{stores.new_run_id()}")
    rows = demo.gold_log(spark, sf)
    log.append(rows.where("coder = 'coder_1'"))
    log.append(rows.where("coder = 'coder_2'"))
    return gold.gold_latest(log.read()).select("item_id", "code_id", "coder", "label", "split", "inclusion_probability", "seq")


def recorded_scores(spark, sf):
    """Answers recorded for the labelled items' texts, as one JSON file, and replayed by item hash."""
    seen = demo.items(spark, sf).join(demo.labels(spark, sf).select("item_id").distinct(), "item_id", "left_semi")
    where = f"{scratch.root(spark)}/recorded-{stores.new_run_id()}.json"
    answers = F.create_map(F.lit("toxic"), F.length("text") % 100 / 100.0, F.lit("high_quality"), F.lit(0.75))
    table = seen.select(hashing.item_hash(F.col("text")).alias("h"), answers.alias("a")).dropDuplicates(["h"])
    body = table.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("h", "a"))))).first()[0]  # labelled texts only: a recording is one small file
    files.write_text(spark, where, '{"model_version": "r1", "probabilities": %s}' % (body or "{}"))
    recorded, model = stores.read_recorded(spark, where)
    scorer = scoring.RecordedBackend(model_version=model, recorded=recorded)
    empty = spark.createDataFrame([], scoring.CACHE_SCHEMA)
    return _r(scoring.run(spark, seen, _codes(spark), scorer, empty, written=scratch.written, max_tokens=1 << 28).scores)


def _reloaded(spark, sf, suffix):
    where = f"{scratch.root(spark)}/corpus-{stores.new_run_id()}.{suffix}"
    rows = demo.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    if suffix == "jsonl":
        rows.write.json(where)
    else:
        rows.write.csv(where, header=True, quoteAll=True, escape='"', sep="\t" if suffix == "tsv" else ",", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return corpus.load_corpus(spark, where, id_column="doc_id").select("item_id", "lang", "source", "item_hash")


def csv_items(spark, sf):
    return _reloaded(spark, sf, "csv")


def tsv_items(spark, sf):
    return _reloaded(spark, sf, "tsv")


def jsonl_items(spark, sf):
    return _reloaded(spark, sf, "jsonl")


def numbered_items(spark, sf):
    """Generated ids carry the place of a row, padded to the width of the count."""
    rows = demo.table(spark, sf, "documents").select("text")
    return corpus.build_items(rows, file_order=True).select("ord", "item_id", "item_hash")


def labelled_items(spark, sf):
    return corpus.subset(demo.ids(spark, sf), demo.labels(spark, sf))


def definitions(spark, sf):
    """Benchmark texts as the definitions of a codebook: normal form, hash, questions' tokens and advice. A codebook is small and read on the driver."""
    rows = demo.table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), "item_id").alias("c"), "text").collect()
    book = settings.Codebook(tuple(settings.parse_code(r["c"], {"definition": r["text"]}) for r in rows))
    advised = {w.partition(":")[0] for w in settings.definition_warnings(book)}
    table = book.table(spark).select("code_id", "norm_definition", "code_hash")
    extra = [(c.code_id, scoring.Question(c.code_id, c.definition).tokens, c.code_id in advised) for c in book.codes]
    return table.join(F.broadcast(spark.createDataFrame(extra, "code_id string, n_tokens long, advised boolean")), "code_id")


def code_batches(spark, sf):
    """Calls that each document takes for 40 codes of 50 tokens under budgets of 2,000 and 800."""
    asked = [scoring.Question(f"c{i}", "d" * 196) for i in range(40)]

    def cut(batches):
        for frame in batches:
            frame["n_calls"] = [len(scoring.split_codes(t, asked, 2000, 800)) for t in frame.pop("text")]
            yield frame

    return demo.items(spark, sf).select("item_id", "text").mapInPandas(cut, "item_id string, n_calls long")


def gold_scores(spark, sf):
    """Primary judgements beside their probabilities; what the scorer did not serve (German) drops out."""
    served = demo.table(spark, sf, "documents").where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("item_id"))
    p = demo.scores(spark, sf).join(served, "item_id", "left_semi")
    return _r(check.gold_scores(gold.labels_for(demo.gold_log(spark, sf), coder="coder_1"), p))


def full_check(spark, sf):
    """The whole check of the corrected gold log, with a code that nobody judged."""
    book = demo.codes(spark).unionByName(spark.createDataFrame([("unjudged",)], "code_id string"))
    made = check.run_check(demo.gold_log(spark, sf), demo.scores(spark, sf), alpha=ALPHA, codes=book)
    return _r(made.select("code_id", "n_gold", "n_gold_positive", "n_test", "t_lo", "t_hi", "coverage", "kappa", "verdict", "reason", "positive_risk", "negative_risk", "brier", "ece", "human_kappa", "human_alpha", "advice"))


def check_summary(spark, sf):
    log = demo.gold_log(spark, sf)
    return _r(check.summary(log, check.certify(demo.even(spark, sf), alpha=ALPHA)))


def certified_decisions(spark, sf):
    """Bands as they were fitted and graded, applied to the corpus."""
    bands = check.certify(demo.even(spark, sf), alpha=ALPHA)
    return coding.apply_bands(demo.ids(spark, sf), demo.codes(spark), bands, demo.scores(spark, sf))


def streamed_decisions(spark, sf):
    """Scores as a stream of files, coded as they come."""
    where, of = scratch.root(spark), stores.new_run_id()
    scores = scratch.written(demo.scores(spark, sf), "scores")
    came = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 2).parquet(scores._scratch)
    coder.drained(coder.coded_stream(came, _bands(spark)), f"{where}/coded-{of}", f"{where}/progress-{of}")
    return spark.read.parquet(f"{where}/coded-{of}")


def certified_risk(spark, sf):
    gs = demo.even(spark, sf)
    return _r(thresholds.realised_risk(_test(gs), check.certify(gs, alpha=ALPHA)))


def comparison_kappas(spark, sf):
    gs = demo.even(spark, sf)
    one = check.certify(gs, alpha=ALPHA).withColumn("backend", F.lit("sharp"))
    two = check.certify(gs.withColumn("p", F.lit(0.5)), alpha=ALPHA).withColumn("backend", F.lit("blunt"))
    costs = spark.createDataFrame([("sharp", 1.5), ("blunt", None)], "backend string, cost double")
    made = check.compare(one.unionByName(two), costs)
    return _r(made.select("backend", "cost", F.explode("kappas").alias("code_id", "kappa")))


def human_interval(spark, sf):
    return _r(check.human_interval(demo.gold_log(spark, sf)))


def gold_plan(spark, sf):
    """120 items over both certified splits."""
    found, parts = demo.splits(spark, sf), []
    for split, n in zip(("calibration", "test"), sampling.allocation(121, 0.45, 0.55), strict=True):
        parts.append(sampling.plan_uniform(splits.of_split(found, split), n, split=split, seed=7))
    return parts[0].unionByName(parts[1])


def enrich_round(spark, sf):
    """A round of enrichment after 60 uniform draws."""
    ids = splits.of_split(demo.splits(spark, sf), "calibration")
    base, take = sampling.enrich_settings(60, ids.count(), 80)
    return _r(sampling.plan_enriched(enrichment_pool(spark, sf), plan_uniform(spark, sf), take, split="calibration", seed=7, base_inclusion=base, code_id="toxic"))


def curve_table(spark, sf):
    """The report's thinned selective curve."""
    rows = [r.asDict() for r in selective.selective_curve(_test(demo.weighted(spark, sf))).orderBy("code_id", "band_id").collect()]  # 15 points a code
    return _r(spark.createDataFrame([(r["code_id"], r["band_id"], r["coverage"]) for r in report.decimate(rows)], "code_id string, band_id int, coverage double"))


def logprob_probabilities(spark, sf):
    """Log-probabilities above 0, as some services round them, are certain."""
    return _r(demo.scores(spark, sf).select("item_id", "code_id", stats.from_logprob(F.log("probability") + 0.05).alias("probability")))


def valid_probabilities(spark, sf):
    return _r(demo.scores(spark, sf).select("item_id", "code_id", stats.valid_probability(F.col("probability"), F.col("code_id")).alias("probability")))


def backend_comparison(spark, sf):
    gs = demo.even(spark, sf)
    one = check.certify(gs, alpha=ALPHA).withColumn("backend", F.lit("sharp"))
    two = check.certify(gs.withColumn("p", F.lit(0.5)), alpha=ALPHA).withColumn("backend", F.lit("blunt"))
    return _r(check.compare(one.unionByName(two)).select("backend", "usable", "share"))


def review_share(spark, sf):
    return _r(check.share_needing_review(check.certify(demo.even(spark, sf), alpha=ALPHA)))


def replayed(spark, sf):
    """Recorded answers of labelled items by item hash, missing ones null."""
    units_ = demo.items(spark, sf).select("item_id", hashing.item_hash(F.col("text")).alias("item_hash"))
    rec = units_.join(demo.labels(spark, sf).select("item_id"), "item_id", "left_semi").select("item_hash", F.lit("toxic").alias("code_id"), F.lit(0.25).alias("probability")).distinct()
    return scoring.replay(units_, demo.codes(spark), rec, strict=False).select("item_id", "code_id", "probability")


QUERIES = {
    f.__name__: f
    for f in (
        certify, split_assignment, split_counts, split_violations, item_hashes, corpus_digest, length_stats, confusion, effective_sizes, brier, reliability, calibration_error,
        band_grid, band_candidates, band_fit, evidence_shortfall, realised_risk, selective_curve, labour_curve, random_baseline, bootstrap_interval, most_informative, gold_latest,
        primary_coder, coded_pairs, gold_labels, double_coded, human_ceiling, human_labels, gold_summary, plan_uniform, enrichment_pool, plan_enriched, plan_overlap, decisions,
        decision_sources, decision_coverage, coded_table, abstentions, review_queue, code_drift, distinct_texts, passages, pooled_scores, run_scores, run_failures, run_cache, cache_hits, cache_misses, run_cost,
        backend_comparison, review_share, replayed, run_usage, retried_scores, saved_run, saved_splits, gold_log_read, recorded_scores, csv_items, tsv_items, jsonl_items,
        numbered_items, labelled_items, definitions, code_batches, gold_scores, full_check, check_summary, certified_decisions, streamed_decisions, certified_risk, comparison_kappas, human_interval,
        gold_plan, enrich_round, curve_table, logprob_probabilities, valid_probabilities,
    )
}
