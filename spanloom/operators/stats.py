"""Order statistics, averages, arg-max, precision and recall, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numbers import f_measure, safe_ratio
from spanloom.operators.running import running


def order_statistics(df: DataFrame, group: list[str], value: str, orders: list[float] = (0.0, 0.25, 0.5, 0.75, 1.0), name: str = "q") -> DataFrame:
    """group, n, mean and one column per order: the value at index floor(p n), at most n - 1.

    Values are counted per (group, value) first; positions come from running counts over a range sort, so no group is
    gathered in a task. Null values don't count.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(per, list(group), [value], {"__end": F.col("__n")})
    total = F.col("__end_total")
    at = lambda p: F.least(F.floor(F.lit(float(p)) * total), total - 1)
    picks = [F.max(F.when((at(p) < F.col("__end")) & (at(p) >= F.col("__end") - F.col("__n")), F.col(value))).alias(f"{name}{round(p * 100)}") for p in orders]
    return ranked.groupBy(*group).agg(F.max(total).alias("n"), (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), *picks)


def arg_best(df: DataFrame, group: list[str], item: str, score: str, order: str, largest: bool = True) -> DataFrame:
    """group, item, score, offers: the best item, the first of equals; infinite and NaN scores are no offers."""
    s = F.col(score).cast("double")
    ok = df.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
    pick = F.max_by if largest else F.min_by
    tie = -F.col(order) if largest else F.col(order)
    best = ok.groupBy(*group).agg(pick(F.struct(F.col(item).alias("item"), F.col(score).alias("score")), F.struct(F.col(score), tie)).alias("b"), F.count(F.lit(1)).alias("offers"))
    return best.select(*group, F.col("b.item").alias("item"), F.col("b.score").alias("score"), "offers")


def exponential_average(df: DataFrame, group: list[str], value: str, order: list[str], decay: float) -> DataFrame:
    """group, n, ema: the first value, then decay * ema + (1 - decay) * value in the stated order.

    The fold has the closed form sum of w_i x_i with w_i = (1 - d) d^(n - i), w_1 = d^(n - 1), so it is a running count over
    a range sort and a sum: no group is gathered in a task, whatever its size.
    """
    ranked = running(df.filter(F.col(value).isNotNull()).select(*group, *dict.fromkeys([value, *order])), list(group), order, {"__i": F.lit(1)})
    weight = F.pow(F.lit(float(decay)), F.col("__i_total") - F.col("__i")) * F.when(F.col("__i") == 1, 1.0).otherwise(1.0 - decay)
    return ranked.groupBy(*group).agg(F.max("__i_total").alias("n"), F.sum(weight * F.col(value)).alias("ema"))


def floor_zero_summary(df: DataFrame, group: list[str], weight: str) -> DataFrame:
    """group, max (never below 0), sum, avg (0 for none) of weights."""
    return df.groupBy(*group).agg(F.greatest(F.max(weight), F.lit(0.0)).alias("max_w"), F.sum(weight).alias("sum_w"), F.coalesce(F.avg(weight), F.lit(0.0)).alias("avg_w"))


def confusion(df: DataFrame, group: list[str], gold: str, predicted: str) -> DataFrame:
    """group, tp, fp, fn, tn (A15, A18). A null label is false."""
    g, p = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*group).agg(n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn"), n(~g & ~p).alias("tn"))


def scores(conf: DataFrame, beta: float = 1.0) -> DataFrame:
    """conf with precision, recall (1 on an empty denominator) and f (0 if both are 0)."""
    out = conf.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f", f_measure(F.col("precision"), F.col("recall"), beta))


def macro_scores(conf: DataFrame, beta: float = 1.0) -> DataFrame:
    """precision, recall, f of the mean precision and recall of the groups."""
    m = scores(conf).agg(F.coalesce(F.avg("precision"), F.lit(1.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(1.0)).alias("recall"))
    return m.withColumn("f", f_measure(F.col("precision"), F.col("recall"), beta))


def combine(*confs: DataFrame, keys: list[str]) -> DataFrame:
    """Stratified counts added by key."""
    both = confs[0]
    for c in confs[1:]:
        both = both.unionByName(c)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def compare_sets(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of two sets of rows (A16); each side is made distinct by the join's own shuffle."""
    g = gold.select(*keys).distinct().withColumn("__g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    j = g.join(p, keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    has_g, has_p = F.col("__g").isNotNull(), F.col("__p").isNotNull()
    return j.agg(n(has_g & has_p).alias("tp"), n(~has_g & has_p).alias("fp"), n(has_g & ~has_p).alias("fn"))


def best_threshold(df: DataFrame, gold: str, score: str, order: str, mode: str = "f1", penalty: float = 0.00033546262790251185) -> DataFrame:
    """threshold, score: the midpoint between neighbouring scores that maximises F1 or accuracy less penalty * threshold^2.

    Cuts before the second and after the last but one score aren't tried; (0, 0) is the start, which only a better score
    replaces; the lowest of equal thresholds wins. Rows tie by `order`. Running counts come from a range sort, so the sweep
    is spread over the cluster; NaN scores are left out.
    """
    rows = df.select(F.coalesce(F.col(gold), F.lit(False)).cast("int").alias("y"), F.col(score).cast("double").alias("s"), F.col(order).alias("o")).filter("s is not null and not isnan(s)")
    swept = running(rows, [], ["s", "o"], {"fn": F.col("y"), "k": F.lit(1)}, lead={"up": "s"}).withColumn("i", F.col("k") - 1)
    n, pos = F.col("k_total"), F.col("fn_total")
    tp = pos - F.col("fn")
    tn = F.col("i") + 1 - F.col("fn")
    fp = n - F.col("i") - 1 - tp
    thresh = (F.col("s") + F.col("up")) / 2
    prec, rec = tp / F.when(tp + fp != 0, tp + fp), tp / F.when(tp + F.col("fn") != 0, tp + F.col("fn"))
    value = 2 * prec * rec / F.when(prec + rec != 0, prec + rec) if mode == "f1" else (tp + tn) / n
    tried = swept.filter((F.col("i") >= 1) & (F.col("i") < n - 1)).select(thresh.alias("threshold"), (value - F.lit(penalty) * thresh * thresh).alias("score")).filter("score > 0")
    best = tried.agg(F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.t"), F.lit(0.0)).alias("threshold"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
