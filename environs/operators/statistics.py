"""Rank correlation, calibration and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring
from .ranks import average_rank, running, with_rank
from .spatial import to_all

NAN = float("nan")


def pearson(x: Column, y: Column) -> Column:
    """Correlation; NaN where a side doesn't vary or there are fewer than two rows."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(NAN))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = with_rank(r, by, x).select(*by, y, average_rank().alias("rx"))
    r = with_rank(r, by, y).select(*by, "rx", average_rank().alias("ry"))
    return r.groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def gamma(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(C - D) / (C + D) over pairs that neither side ties (Goodman and Kruskal), without making the pairs.

    Ranks of x are read bit by bit: two rows part at the first bit in which their ranks differ. For each bit, rows with a common
    prefix are counted by y and ordered by ranges, so that the top bit of a large group is spread over all tasks, and what stands below and
    above gives the ones their concordant and discordant partners among the zeros. The work is n log n.
    """
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    # rows with the same x and y are counted before their bits are read
    r = with_rank(r, by, x).groupBy(*by, F.col("less").alias("rx"), y, "total").agg(F.count(F.lit(1)).alias("n"))
    r = r.withColumn("bits", F.ceil(F.log2(F.col("total").cast("double"))).cast("int"))
    # bits may be 0: a single row has no pair, and an empty sequence gives no row
    r = r.withColumn("bit", F.explode(F.when(F.col("bits") > 0, F.sequence(F.lit(0), F.col("bits") - 1)).otherwise(F.array().cast("array<int>"))))
    one = F.expr("shiftright(rx, bit) % 2")
    r = r.select(*by, "bit", F.expr("shiftright(rx, bit + 1)").alias("prefix"), y, "n", one.alias("one"))
    counts = r.groupBy(*by, "bit", "prefix", y).agg(F.sum(F.col("n") * F.col("one")).alias("ones"), F.sum(F.col("n") * (1 - F.col("one"))).alias("zeros"))
    # a prefix without a one or without a zero has no pair
    d = running(counts, [*by, "bit", "prefix"], y, ["zeros"])
    d = d.withColumn("c", F.col("ones") * F.col("before_zeros")).withColumn("d", F.col("ones") * (F.col("all_zeros") - F.col("before_zeros") - F.col("zeros")))
    out = d.groupBy(*by).agg(F.sum("c").alias("concordant"), F.sum("d").alias("discordant"))
    both = F.col("concordant") + F.col("discordant")
    return out.withColumn("gamma", F.when(both > 0, (F.col("concordant") - F.col("discordant")) / both).otherwise(F.lit(NAN)))


def label_error(df: DataFrame, pairs: dict[str, tuple[str, str, bool]], by: list[str]) -> DataFrame:
    """Mean absolute error of labels 1 to 5, rescaled to 0 to 100, by group and name; pairs: name -> (label, score, inverted)."""

    def error(label: str, score: str, inverted: bool) -> Column:
        scaled = (F.col(label) - 1) / 4.0 * 100
        return F.abs((100 - scaled if inverted else scaled) - F.col(score))

    errors = F.array(*[F.struct(F.lit(n).alias("dimension"), error(*p).alias("error")) for n, p in pairs.items()])
    return df.select(*by, F.explode(errors).alias("e")).groupBy(*by, "e.dimension").agg(F.avg("e.error").alias("mae"))


def calibration(df: DataFrame, pairs: dict[str, tuple[str, str]], variants: dict[str, Column], bar: float = 0.6) -> DataFrame:
    """variant, pair, rho, n, below: Spearman's rho of each label and score, over all rows that a variant keeps."""
    kept = F.array_compact(F.array(*[F.when(c, v) for v, c in variants.items()]))
    values = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in pairs.items()])
    long = df.select(F.explode(kept).alias("variant"), values.alias("p")).select("variant", F.explode("p").alias("p")).select("variant", "p.pair", "p.x", "p.y")
    found = spearman(long, "x", "y", ["variant", "pair"])
    return found.withColumn("below", F.coalesce(~F.isnan("rho") & (F.col("rho") < bar), F.lit(False)))


def by_group(df: DataFrame, x: str, y: str, by: str, least: int = 3, bar: float = 0.5) -> DataFrame:
    """The strict rule: rho by group where it has at least ``least`` rows, with whether it reaches the bar; NaN where nothing varies."""
    return spearman(df, x, y, [by]).where(F.col("n") >= least).withColumn("accepted", F.coalesce(~F.isnan("rho") & (F.col("rho") >= bar), F.lit(False)))


def perturbed_weights(weights: dict[str, float], factors: tuple[float, ...] = (0.7, 1.3)) -> list[tuple[str, float, dict[str, float]]]:
    """One scenario for each weight and factor; the others are rebalanced in proportion, so that the sum stays 1."""
    out = []
    for name, w in weights.items():
        for f in factors:
            new = min(1.0, w * f)
            rest = 1 - w
            out.append((name, f, {k: new if k == name else (v * (1 - new) / rest if rest else 0.0) for k, v in weights.items()}))
    return out


def persona_scenarios(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """scores(city_id, id, dimensions) -> a row for each hotel and scenario: a literal array is exploded, nothing is joined."""
    cases = [
        F.struct(F.lit(n).alias("weight"), F.lit(f).alias("factor"), sum((F.lit(v) * F.col(k) for k, v in w.items()), F.lit(0.0)).alias("value")) for n, f, w in perturbed_weights(weights)
    ]
    base = sum((F.lit(v) * F.col(k) for k, v in weights.items()), F.lit(0.0))
    return scores.select("city_id", "id", base.alias("base"), F.explode(F.array(*cases)).alias("c")).select("city_id", "id", "base", "c.weight", "c.factor", "c.value")


def decay_sweep(near: DataFrame, dimension: str, factors: tuple[float, ...] = (0.5, 0.7, 1.0, 1.3)) -> DataFrame:
    """Decayed counts under each factor of the decay scale, from pairs(city_id, id, n, d) that were met once, n points at a place."""
    sums = [F.sum(F.col("n") * F.exp(-F.col("d") / F.lit(C.DECAY_M[dimension] * f))).alias(f"f{i}") for i, f in enumerate(factors)]
    wide = near.groupBy("city_id", "id").agg(*sums)
    return wide.select("city_id", "id", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"f{i}").alias("raw")) for i, f in enumerate(factors)])).alias("s")).select("city_id", "id", "s.factor", "s.raw")


#: FIXED VALUES: factors of scales and weights, and other shares of the absolute part.
FACTORS, ABSOLUTE_SHARES = (1.3, 0.7), (0.5, 0.9)


def sensitivity(near: DataFrame, hotels: DataFrame, quiet: DataFrame) -> DataFrame:
    """city_id, id, scenario, base, value: scores of a dimension as they are and under one changed constant, 22 scenarios.

    hotels are as ``sited`` gives them; near(city_id, id, flags, food, mode, n, d) are the pairs of their sites within 800 m, met once;
    quiet(city_id, id, *_nearest_m) the nearest penalties of every hotel.
    Decay scales and penalty weights are changed by FACTORS, the share of the absolute part is set to ABSOLUTE_SHARES. Values are rounded
    to six digits, so that they tie alike on all machines.
    """
    key, scales = ["city_id", "id"], (1.0, *FACTORS)
    out = []
    for i, dim in enumerate(C.DENSITY):
        hit = (F.col("flags").bitwiseAND(1 << i) != 0) & (F.col("d") <= C.RADIUS_M[dim])
        out += [F.sum(F.when(hit, F.col("n") * scoring.decay(F.col("d"), C.DECAY_M[dim] * f))).alias(f"{dim}_{n}") for n, f in enumerate(scales)]
    kinds = F.when((F.col("food") > 0) & (F.col("d") <= C.RADIUS_M["food_essentials"]), F.expr("shiftleft(1, food)"))
    modes = C.CATEGORIES["transit_access"]
    out += [F.bit_count(F.bit_or(kinds)).alias("kinds"), *[F.min(F.when((F.col("mode") == i) & (F.col("d") <= C.RADIUS_M["transit_access"]), F.col("d"))).alias(f"mode_{i}") for i in range(1, len(modes) + 1)]]
    d = to_all(hotels, near.groupBy(*key).agg(*out)).join(quiet.drop("score"), key)
    found = F.array_compact(F.array(*[F.col(f"mode_{i}") for i in range(1, len(modes) + 1)]))
    score: dict[str, Column] = {}
    for dim in C.DENSITY:
        for n in range(len(scales)):
            raw = F.coalesce(f"{dim}_{n}", F.lit(0.0))
            raw = scoring.diversity(raw, F.coalesce("kinds", F.lit(0))) if dim == "food_essentials" else raw
            d = d.withColumn(f"{dim}_{n}", F.round(raw, 9))
        shares = [(n, C.ABSOLUTE_WEIGHT) for n in range(len(scales))] + [(0, w) for w in ABSOLUTE_SHARES]
        for n, w in shares:
            score[f"{dim}/{n}/{w}"] = scoring.hybrid(scoring.saturating(F.col(f"{dim}_{n}"), C.SATURATION[dim]), scoring.percentile_in_city(F.col(f"{dim}_{n}")), w)
    for n, f in enumerate(scales):
        best = F.lit(100.0) * scoring.decay(F.array_min(found), C.DECAY_M["transit_access"] * f)
        score[f"transit_access/{n}"] = scoring.transit(best, F.size(found))
    cases = [(f"decay {dim} {f}", f"{dim}/0/{C.ABSOLUTE_WEIGHT}", f"{dim}/{n}/{C.ABSOLUTE_WEIGHT}") for dim in C.DENSITY for n, f in enumerate(scales) if n]
    cases += [(f"decay transit_access {f}", "transit_access/0", f"transit_access/{n}") for n, f in enumerate(scales) if n]
    cases += [(f"share {dim} {w}", f"{dim}/0/{C.ABSOLUTE_WEIGHT}", f"{dim}/0/{w}") for dim in C.DENSITY for w in ABSOLUTE_SHARES]
    lost = {k: F.coalesce(scoring.decay(F.col(f"{k}_nearest_m"), p[1]), F.lit(0.0)) for k, p in C.PENALTIES.items()}

    def quietness(changed: str | None = None, factor: float = 1.0) -> Column:
        left = F.lit(float(C.QUIET_START))
        for k, p in C.PENALTIES.items():
            left = left - F.lit(p[0] * (factor if k == changed else 1.0)) * lost[k]
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), left))

    score["quiet"] = quietness()
    for k in C.PENALTIES:
        for f in FACTORS:
            score[f"quiet/{k}/{f}"] = quietness(k, f)
            cases.append((f"penalty {k} {f}", "quiet", f"quiet/{k}/{f}"))
    names = {c: f"s{i}" for i, c in enumerate(score)}
    d = d.select(*key, *[F.round(c, 6).alias(names[n]) for n, c in score.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(names[b]).alias("base"), F.col(names[v]).alias("value")) for n, b, v in cases])
    return d.select(*key, F.explode(rows).alias("c")).select(*key, "c.scenario", "c.base", "c.value")
