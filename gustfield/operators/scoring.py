"""Scores of a modelled wind against a measured one: errors, strata, debiasing, leave-one-group-out, transfer between runs.

A pair has ``obs_speed``, ``obs_from`` (null: no direction), ``calm``, ``mod_speed``, ``mod_from``. Everything is sums, so it is
combined before the shuffle and one group never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import circular_mean, east, north, signed_gap

#: Smallest measured speed whose direction is scored; ceiling below which an instrument says calm (2 kt), in m/s.
MIN_DIRECTION, CALM_CEILING = 1.0, 2 * 1852 / 3600


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def errors(pairs: DataFrame, scale: float | Column = 1.0, min_direction: float = MIN_DIRECTION) -> DataFrame:
    """Adds the modelled speed after scaling and the errors of a pair: ``speed_err``, ``dir_err``, ``vec_err2`` (null where undefined)."""
    c = F.col
    m = c("mod_speed") * scale
    has = c("obs_from").isNotNull()
    vector = m.isNotNull() & (c("calm") | has) & c("mod_from").isNotNull()
    oe, on = F.when(c("calm"), 0.0).otherwise(east("obs_speed", "obs_from")), F.when(c("calm"), 0.0).otherwise(north("obs_speed", "obs_from"))
    direction = m.isNotNull() & ~c("calm") & has & (c("obs_speed") >= min_direction) & c("mod_from").isNotNull()
    return pairs.withColumns({
        "mod_scaled": m,
        "speed_err": m - c("obs_speed"),
        "dir_err": F.when(direction, signed_gap("mod_from", "obs_from")),
        "vec_err2": F.when(vector, F.pow(east(m, "mod_from") - oe, 2) + F.pow(north(m, "mod_from") - on, 2)),
        "dir_skip": F.when(m.isNull(), F.lit(None).cast("string")).when(c("calm"), "calm").when(~has, "no-direction").when(c("obs_speed") < min_direction, "light").when(c("mod_from").isNull(), "no-direction"),
    })


def score(pairs: DataFrame, by: list[str] | None = None, scale: float | Column = 1.0, sample: Column | None = None, calm_ceiling: float = CALM_CEILING, min_direction: float = MIN_DIRECTION) -> DataFrame:
    """One row for each stratum of ``by``. ``sample`` identifies a model sample: distinct ones are counted over all pairs, scored or not."""
    e, c = errors(pairs, scale, min_direction), F.col
    scored = c("speed_err").isNotNull()
    n = F.count("speed_err")
    calm = F.count_if(scored & c("calm"))
    out = [
        n.alias("n"), F.avg("speed_err").alias("bias"),
        F.when(n > 0, calm * calm_ceiling / n).otherwise(0.0).alias("bias_censoring"),
        F.avg(F.abs(c("speed_err"))).alias("mae"), rms(c("speed_err")).alias("rmse"),
        F.avg(F.when(scored, c("obs_speed"))).alias("mean_observed"), F.avg(F.when(scored, c("mod_scaled"))).alias("mean_modelled"),
        F.count("dir_err").alias("dir_n"), circular_mean("dir_err").alias("dir_bias"), F.avg(F.abs(c("dir_err"))).alias("dir_mae"), rms(c("dir_err")).alias("dir_rmse"),
        F.count_if(F.abs(c("dir_err")) <= 30).alias("within_30"),
        F.count("vec_err2").alias("vec_n"), F.sqrt(F.avg("vec_err2")).alias("vec_rmse"),
        calm.alias("calm"), F.count_if(c("dir_skip") == "light").alias("light"), F.count_if(c("dir_skip") == "no-direction").alias("no_direction"),
    ]
    if sample is not None:
        out.append(F.countDistinct(sample).alias("distinct_samples"))
    return e.groupBy(*(by or [])).agg(*out)


def ratio_scale(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of the measured over sum of the modelled speeds, where the latter is positive."""
    ok = F.col("mod_speed").isNotNull()
    m, o = F.sum("mod_speed"), F.sum(F.when(ok, F.col("obs_speed")))
    return pairs.groupBy(*(by or [])).agg(F.when(m > 0, o / m).alias("scale"))


def sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sufficient statistics of speeds: n, o, m, oo, mm, om."""
    o, m = F.col("obs_speed"), F.col("mod_speed")
    own = pairs.where(m.isNotNull() & o.isNotNull())
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.sum(o).alias("o"), F.sum(m).alias("m"), F.sum(o * o).alias("oo"), F.sum(m * m).alias("mm"), F.sum(o * m).alias("om"))


NAMES = ["n", "o", "m", "oo", "mm", "om"]


def rmse_of(s, scale: Column) -> Column:
    """RMSE after scaling, from sufficient statistics; ``s`` maps their names to columns."""
    return F.when(s("n") > 0, F.sqrt(F.greatest((scale * scale * s("mm") - 2 * scale * s("om") + s("oo")) / s("n"), F.lit(0.0))))


def lsq_scale(s=F.col) -> Column:
    return F.when(s("mm") > 0, s("om") / s("mm"))


def leave_one_out(pairs: DataFrame, group: str, by: list[str] | None = None, debias: bool = False, first: Column | None = None) -> DataFrame:
    """For each group the speed RMSE of all pairs and of those without it (debias: with a ratio scale fitted on the same pairs anew).

    Columns: ``by``, group, seq (order of the groups), n, n_remaining, full, without, delta. Totals come from the groups' sums: one
    row a group, not a pair.
    """
    by = by or []
    g = sums(pairs, [*by, group])
    total = g.groupBy(*by).agg(*[F.sum(x).alias(f"t_{x}") for x in NAMES])
    j = g.join(F.broadcast(total), by) if by else g.crossJoin(F.broadcast(total))  # one row of totals
    rest, full = (lambda x: F.col(f"t_{x}") - F.col(x)), (lambda x: F.col(f"t_{x}"))
    one = lambda s: F.when(s("m") > 0, s("o") / s("m")) if debias else F.lit(1.0)
    left = F.when(rest("n") > 0, rmse_of(rest, one(rest)))
    whole = rmse_of(full, one(full))
    return j.select(*by, group, F.col("n"), rest("n").alias("n_remaining"), whole.alias("full"), left.alias("without"), (left - whole).alias("delta"))


class Metric:
    """A metric from sums: ``parts`` (name -> what is summed over pairs, a column of ``errors``) and ``value`` (from a lookup of the sums to a column).

    Any metric that is a function of sums can be left one out of without a second pass over the pairs.
    """

    def __init__(self, parts: dict[str, Column], value: Callable[[Callable[[str], Column]], Column]):
        self.parts, self.value = parts, value


def vector_rmse() -> Metric:
    e = F.col("vec_err2")
    return Metric({"n": F.when(e.isNotNull(), 1).otherwise(0), "e": e}, lambda s: F.when(s("n") > 0, F.sqrt(F.greatest(s("e"), F.lit(0.0)) / s("n"))))


def circular_bias() -> Metric:
    d = F.radians("dir_err")
    apart = lambda s: (F.abs(s("s")) < 1e-9) & (F.abs(s("c")) < 1e-9)
    return Metric({"n": F.when(d.isNotNull(), 1).otherwise(0), "s": F.sin(d), "c": F.cos(d)}, lambda s: F.when((s("n") > 0) & ~apart(s), F.degrees(F.atan2(s("s"), s("c")))))


def leave_one_out_of(pairs: DataFrame, group: str, metrics: dict[str, Metric], by: list[str] | None = None, scale: float | Column = 1.0) -> DataFrame:
    """For each group and metric m: ``m`` (all pairs of the stratum), ``m_without`` (all but the group's), ``m_delta``; one pass for all metrics and folds.

    Sums by group are combined before the shuffle; a stratum's totals are sums of these. A group may hold most pairs: it is one row.
    """
    by = by or []
    part = {f"{m}_{k}": c for m, x in metrics.items() for k, c in x.parts.items()}
    own = errors(pairs, scale).groupBy(*by, group).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in part.items()])
    total = own.groupBy(*by).agg(*[F.sum(k).alias(f"all_{k}") for k in part])
    j = own.join(total, by) if by else own.crossJoin(F.broadcast(total))  # one row of totals
    out = []
    for m, x in metrics.items():
        whole, rest = x.value(lambda k, m=m: F.col(f"all_{m}_{k}")), x.value(lambda k, m=m: F.col(f"all_{m}_{k}") - F.col(f"{m}_{k}"))
        out += [whole.alias(m), rest.alias(f"{m}_without"), (rest - whole).alias(f"{m}_delta")]
    return j.select(*by, group, *out)


def leverage(folds: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """Per stratum: groups, full, lower median, least and largest RMSE without one, and the group that carries most (first of ties by name)."""
    by = by or []
    best = F.max_by(F.struct(F.col(group).alias("g"), F.col("delta").alias("d")), F.struct(F.col("delta"), -F.col(group)))
    return folds.groupBy(*by).agg(F.count("*").alias("groups"), F.first("full").alias("full"), F.percentile("without", F.lit(0.5)).alias("_"), F.expr("percentile_disc(0.5) within group (order by without)").alias("median_without"), F.min("without").alias("least_without"), F.max("without").alias("most_without"), F.max("delta").alias("max_delta"), best.getField("g").alias("carrying")).drop("_")


def winners(folds: DataFrame, group: str, candidate: str, order: str) -> DataFrame:
    """The candidate with the least RMSE when a group is left out (earlier in ``order`` on ties)."""
    return folds.groupBy(group).agg(F.min_by(candidate, F.struct("without", order)).alias("winner"))


def transfer(fit: DataFrame, evaluate: DataFrame, group: str, least: int = 6) -> DataFrame:
    """Speed scales fitted by group on one run, scored on another: RMSE raw, with the pooled scale, the transferred ones, and those of hindsight.

    Both runs are tables of ``sums``; groups of fewer than ``least`` pairs don't count.
    """
    f = fit.where(F.col("n") >= least).select(group, lsq_scale().alias("k"))
    e = evaluate.where(F.col("n") >= least).join(f.where("k is not null"), group)
    pooled = e.agg((F.sum("om") / F.sum("mm")).alias("p"))
    part = lambda k: F.sqrt(F.sum(k * k * F.col("mm") - 2 * k * F.col("om") + F.col("oo")) / F.sum("n"))
    return e.crossJoin(F.broadcast(pooled)).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), part(F.lit(1.0)).alias("raw"), part(F.col("p")).alias("pooled"), part(F.col("k")).alias("transferred"), part(lsq_scale()).alias("hindsight"))


def offset_transfer(fit: DataFrame, evaluate: DataFrame, group: str, least: int = 6) -> DataFrame:
    """The same with biases taken off: per pair n * (rmse^2 - 2 c bias + c^2) sums."""
    bias = lambda: (F.col("m") - F.col("o")) / F.col("n")
    f = fit.where(F.col("n") >= least).select(group, bias().alias("k"))
    e = evaluate.where(F.col("n") >= least).join(f, group).withColumn("b", bias()).withColumn("s2", (F.col("mm") - 2 * F.col("om") + F.col("oo")) / F.col("n"))
    pooled = e.agg((F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("p"))
    part = lambda c: F.sqrt(F.greatest(F.sum(F.col("n") * (F.col("s2") - 2 * c * F.col("b") + c * c)) / F.sum("n"), F.lit(0.0)))
    return e.crossJoin(F.broadcast(pooled)).agg(F.count("*").alias("groups"), part(F.lit(0.0)).alias("raw"), part(F.col("p")).alias("pooled"), part(F.col("k")).alias("transferred"), part(F.col("b")).alias("hindsight"))


def repeatability(a: DataFrame, b: DataFrame, group: str, least: int = 6) -> DataFrame:
    """Pearson's r of the scales of the groups that two runs share; null for fewer than three or without variance."""
    j = a.where(F.col("n") >= least).select(group, lsq_scale().alias("x")).join(b.where(F.col("n") >= least).select(group, lsq_scale().alias("y")), group).where("x is not null and y is not null")
    n, sx, sy, sxx, syy, sxy = F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y")), F.sum(F.col("x") * F.col("y"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return j.agg(n.alias("groups"), F.when((n >= 3) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy)).alias("r"))


def holdout(fit: DataFrame, evaluate: DataFrame, predictor: DataFrame, group: str, least: int = 6) -> DataFrame:
    """Each group's scale predicted from a line through (x, ln scale) of the others, scored on the other run.

    ``predictor`` has group and ``x``. The lines are the totals less one group's part, so there is one row a group and no refit.
    """
    c = F.col
    u = fit.where(c("n") >= least).select(group, lsq_scale().alias("k"), c("om").alias("fom"), c("mm").alias("fmm")).join(evaluate.where(c("n") >= least), group).join(predictor, group)
    u = u.where("k > 0 and x is not null").withColumn("y", F.log("k"))
    terms = {"c": F.lit(1.0), "sx": c("x"), "sy": c("y"), "sxx": c("x") * c("x"), "sxy": c("x") * c("y"), "som": c("fom"), "smm": c("fmm")}
    u = u.withColumns({f"v_{k}": v for k, v in terms.items()})
    total = u.agg(*[F.sum(f"v_{k}").alias(f"t_{k}") for k in terms])
    j = u.crossJoin(F.broadcast(total))
    r = lambda k: c(f"t_{k}") - c(f"v_{k}")
    det = r("c") * r("sxx") - r("sx") * r("sx")
    slope = (r("c") * r("sxy") - r("sx") * r("sy")) / det
    j = j.where((r("c") >= 3) & (det > 0)).withColumn("predicted", F.exp((r("sy") - slope * r("sx")) / r("c") + slope * c("x"))).withColumn("others", r("som") / r("smm"))
    part = lambda k: F.sqrt(F.sum(k * k * c("mm") - 2 * k * c("om") + c("oo")) / F.sum("n"))
    return j.agg(F.count("*").alias("groups"), part(F.lit(1.0)).alias("raw"), part(c("others")).alias("pooled"), part(c("predicted")).alias("predicted_rmse"), part(c("k")).alias("own"))


def first_seen_mode(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The commonest value of each group (of equals the one seen first), how often, and of how many."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("times"), F.min(seq).alias("_s"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("times", -F.col("_s"))).alias("mode"), F.max("times").alias("times"), F.sum("times").alias("of"))


#: Parts of a range that one round of by_rank counts, and tasks that a group's values are dealt to.
RANK_BINS, RANK_SALTS = 1024, 64


def by_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float], rounds: int = 2) -> DataFrame:
    """Values at index floor(share * n), capped at the last, of the sorted values of each group; nulls and NaN aren't counted.

    Nothing sorts a group. Equal values meet first; each round counts the values in RANK_BINS parts of the range that must hold the one asked for and goes on with
    its part; the last window sorts what is left there (a millionth of the range after two rounds). However values are spread, the result is exact.
    """
    c = F.col
    number = c("_v").isNotNull() & ~F.isnan(c("_v").cast("double"))
    values = df.select(*by, c(value).alias("_v")).where(number).groupBy(*by, "_v").agg(F.count("*").alias("_n")).withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(RANK_SALTS)))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.least(F.floor(c("_of") * q), c("_of") - 1).alias("_rank")) for k, q in shares.items()]))
    asked = values.groupBy(*by).agg(F.sum("_n").alias("_of"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(*by, "_lo", "_hi", ranks.alias("_r")).select(*by, "_lo", "_hi", "_r.*")

    def within() -> DataFrame:
        """Values in the part that is asked for; groups may be null. Salts let a big group's values stay in many tasks."""
        a = asked.select(*[c(b).alias(f"_by{i}") for i, b in enumerate(by)], "_lo", "_hi", "_k", "_rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(RANK_SALTS - 1).cast("bigint"))).alias("_as"))
        on = c("_s") == c("_as")
        for i, b in enumerate(by):
            on = on & c(b).eqNullSafe(c(f"_by{i}"))
        return values.join(a, on & c("_v").between(c("_lo"), c("_hi")))

    def holding(counts: DataFrame, order: str) -> DataFrame:
        """The row of each question that holds its rank, which is then counted from that row's first value."""
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumn("_before", before).where((c("_rank") >= c("_before")) & (c("_rank") < c("_before") + c("_n"))).withColumn("_rank", c("_rank") - c("_before"))

    lo, hi, v = (c(k).cast("double") for k in ("_lo", "_hi", "_v"))
    part = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * RANK_BINS), F.lit(RANK_BINS - 1))).otherwise(0)
    for _ in range(rounds):
        counts = within().withColumn("_part", part).groupBy(*by, "_k", "_rank", "_part").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        asked = holding(counts, "_part").select(*by, "_k", "_rank", "_lo", "_hi")
    return holding(within(), "_v").groupBy(*by).agg(*[F.max(F.when(c("_k") == k, c("_v"))).alias(k) for k in shares])
