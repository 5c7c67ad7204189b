"""Reliability against coverage and human labour, and resampling by hash draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hashing import draw
from .thresholds import accepted, decide, grid


def selective_curve(gs: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Per code and band: coverage, and kappa, accuracy and prevalence among the accepted."""
    met = gs.crossJoin(F.broadcast(grid(gs.sparkSession) if bands is None else bands))
    acc, dec = accepted(), decide()
    on = lambda x: F.when(acc, x)
    cells = stats.cells(F.col("g"), F.when(acc, dec), F.col("w"))
    made = met.groupBy("code_id", "band_id", "t_lo", "t_hi").agg(
        F.coalesce(F.sum(on(F.col("w"))) / F.sum("w"), F.lit(0.0)).alias("coverage"), F.count(on(1)).alias("n_accepted"),
        (F.sum(on(F.col("w") * (dec == F.col("g")).cast("double"))) / F.sum(on(F.col("w")))).alias("accuracy"),
        (F.sum(on(F.col("w") * F.col("g"))) / F.sum(on(F.col("w")))).alias("prevalence"), *cells,
    )
    reason = F.when(F.col("n_accepted") == 0, "ALL_ABSTAINED").otherwise(stats.kappa_reason())
    return made.select("code_id", "band_id", "t_lo", "t_hi", "coverage", "n_accepted", stats.kappa().alias("kappa"), reason.alias("reason"), "accuracy", "prevalence")


def delivered(gs: DataFrame, bands: DataFrame, *keys: str, labour_offset: float = 0.0) -> DataFrame:
    """Kappa of the finished dataset (machine where accepted, human elsewhere) by code and `keys` of bands."""
    met = gs.crossJoin(F.broadcast(bands))
    return finished(met, "code_id", *keys, labour_offset=labour_offset)


def finished(met: DataFrame, *keys: str, labour_offset: float = 0.0) -> DataFrame:
    """The same for rows that carry their band; a null band accepts all and decides at one half."""
    acc = F.col("t_hi").isNull() | accepted()
    final = F.when(acc, decide()).otherwise(F.col("g"))
    made = met.groupBy(*keys).agg(F.count("*").alias("n"), stats.clamp01(F.coalesce(stats.weighted_mean(acc.cast("double"), F.col("w")), F.lit(0.0))).alias("coverage"), *stats.cells(F.col("g"), final, F.col("w")))
    return made.select(*keys, "n", "coverage", stats.clamp01(labour_offset + 1 - F.col("coverage")).alias("labour"), stats.kappa().alias("kappa"), stats.kappa_reason().alias("reason"))


def labour_curve(gs: DataFrame, *, labour_offset: float = 0.0, bands: DataFrame | None = None) -> DataFrame:
    """From no review (point 0, no band) to the widest band: 16 points a code."""
    bands = grid(gs.sparkSession) if bands is None else bands
    m = bands.count()
    none = gs.sparkSession.createDataFrame([(0, None, None)], "point int, t_lo double, t_hi double")
    points = none.unionByName(bands.select((m - F.col("band_id")).cast("int").alias("point"), "t_lo", "t_hi"))
    return delivered(gs, points, "point", "t_lo", "t_hi", labour_offset=labour_offset)


def random_baseline(gs: DataFrame, fractions: DataFrame, *, n_resamples: int = 100, seed: int = 0, labour_offset: float = 0.0) -> DataFrame:
    """Code all at one half and hand-check a random share: mean kappa and 95 % interval by code and point.

    fractions(code_id, point, fraction). A row is reviewed in a draw if its rank by hash is within the share; ranks
    depend on the draw alone, so each draw is ranked once for all shares.
    """
    n_of = gs.groupBy("code_id").agg(F.count("*").alias("n"))
    reps = gs.crossJoin(F.broadcast(gs.sparkSession.range(n_resamples).select(F.col("id").cast("int").alias("rep"))))
    keyed = reps.withColumn("key", F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "code_id", "item_id"), 256))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("code_id", "rep").orderBy("key")))
    cut = F.broadcast(fractions.join(n_of, "code_id").select("code_id", "point", "fraction", "n", F.bround(F.col("fraction") * F.col("n")).alias("k")))
    met = ranked.join(cut, "code_id")
    guess = F.when(F.col("p") >= 0.5, 1).otherwise(0)
    final = F.when(F.col("rank") <= F.col("k"), F.col("g")).otherwise(guess)
    each = met.groupBy("code_id", "point", "fraction", "n", "rep").agg(*stats.cells(F.col("g"), final, F.col("w"))).withColumn("kappa", stats.kappa())
    made = each.groupBy("code_id", "point", "fraction", "n").agg(F.avg("kappa").alias("kappa"), F.expr("percentile(kappa, 0.025)").alias("lo"), F.expr("percentile(kappa, 0.975)").alias("hi"))
    return made.select("code_id", "point", (labour_offset + F.col("fraction")).alias("labour"), (1 - F.col("fraction")).alias("coverage"), "kappa", "lo", "hi")


def bootstrap(rows: DataFrame, *, n_resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of kappa by code over rows(code_id, item_id, g, d, w), resampled within each gold class.

    Slot s of replicate r takes item number hash(seed, r, class, s) mod class size; null if fewer than half of the
    replicates have a kappa.
    """
    if not 0 < level < 1 or n_resamples < 1:
        raise ValueError("a level in (0, 1) and at least one resample")
    stratum = Window.partitionBy("code_id", "g")
    numbered = rows.withColumn("slot", F.row_number().over(stratum.orderBy("item_id")) - 1).withColumn("size", F.count("*").over(stratum))
    reps = F.broadcast(rows.sparkSession.range(n_resamples).select(F.col("id").cast("int").alias("rep")))
    drawn = numbered.select("code_id", "g", "slot", "size").crossJoin(reps)
    pick = draw(F.lit(str(seed)), F.col("rep"), F.col("g").cast("int"), F.col("slot")) % F.col("size")
    drawn = drawn.select("code_id", "g", "rep", pick.alias("slot"))
    # equal picks are counted before the join
    times = drawn.groupBy("code_id", "g", "rep", "slot").count()
    met = times.join(numbered, ["code_id", "g", "slot"])
    each = met.groupBy("code_id", "rep").agg(*stats.cells(F.col("g"), F.col("d"), F.col("w") * F.col("count"))).withColumn("kappa", stats.kappa())
    tail = (1 - level) / 2
    made = each.groupBy("code_id").agg(F.count("kappa").alias("defined"), F.expr(f"percentile(kappa, {tail!r}D)").alias("lo"), F.expr(f"percentile(kappa, {1 - tail!r}D)").alias("hi"))
    good = F.col("defined") >= max(1, n_resamples // 2)
    return made.select("code_id", "defined", F.when(good, F.col("lo")).alias("lo"), F.when(good, F.col("hi")).alias("hi"))


def most_informative(calibrated: DataFrame, baseline: DataFrame, *, digits: int = 6) -> DataFrame:
    """The code whose calibrated curve lies furthest above the random one, over points of equal number.

    Means of equal values differ in their last bits by the order of rows, so gains are compared, and given, to `digits`
    digits; of equal codes the first by name.
    """
    met = calibrated.select("code_id", "point", F.col("kappa").alias("k")).join(baseline.select("code_id", "point", F.col("kappa").alias("b")), ["code_id", "point"])
    gain = F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("k") - F.col("b"), F.lit(0.0))))
    return met.groupBy("code_id").agg(F.round(gain, digits).alias("gain")).orderBy(F.col("gain").desc(), "code_id").limit(1)
