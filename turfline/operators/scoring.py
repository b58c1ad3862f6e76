"""Scores, metrics and rankings over scored rows.

Global statistics (min/max, medians, means) are computed as one ungrouped
aggregate and attached as scalar subqueries; rankings use
``row_number`` inside partitions (``WindowGroupLimit`` prunes before the
shuffle) or range-partitioned numbering, never a window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.functions.columns import clip_col, round_half_even, safe_div
from turfline.operators.upsert import assign_row_ids
from turfline.plans.guards import small_side, with_scalars
from turfline.session import stored


#: Values of a group that one aggregate may hold; larger groups are narrowed down first.
SMALL_GROUP = 65_536
#: Cuts of a range in each round of narrowing.
RANGE_CUTS = 64


def group_quantiles(df: DataFrame, group: Sequence[str], cols: Sequence[str], q: float, small: int = SMALL_GROUP) -> DataFrame:
    """group, column, value: the q-quantile of each column in each group, interpolated between the two ranks
    around ``(n - 1) * q`` (numpy's rule). Nulls do not count; a column without values in a group has no
    row. Null group values are a group. Without ``group`` the whole frame is one.

    Groups of at most ``small`` values are aggregated at once. For a larger one the two ranks are narrowed
    down: approximate quantiles cut the range that holds a rank, the values between and on the cuts
    are counted, and the cell with the rank is the next range, until it is one value or has few.
    No task or buffer holds a larger group. There are at most rows / ``small`` such groups, which are broadcast.
    """
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    values = stored(df.select(key.alias("key"), F.inline(cells)).where(F.col("v").isNotNull()), "values")
    of = ["key", "column"]
    sizes = values.groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > small), "large")
    out = values.join(F.broadcast(large.drop("n")), of, "left_anti").groupBy(*of).agg(F.percentile("v", q).alias("value"))
    if not large.isEmpty():
        out = out.unionByName(_narrowed(values, large, q, small))
    return out.select(*[F.col("key")[c].alias(c) for c in group], "column", "value")


def _narrowed(values: DataFrame, large: DataFrame, q: float, small: int) -> DataFrame:
    """key, column, value of the large groups, by rounds of narrowing."""
    of = ["key", "column", "rank"]
    at = (F.col("n") - 1) * F.lit(float(q))
    ranks = large.select("key", "column", "n", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    none = F.lit(None).cast("double")
    open_ = ranks.select(*of, "n", F.lit(0).cast("long").alias("before"), none.alias("lo"), none.alias("hi"))
    shares = [k / RANGE_CUTS for k in range(1, RANGE_CUTS)]
    found: DataFrame | None = None

    def inside(targets: DataFrame) -> DataFrame:
        rows = values.join(F.broadcast(targets.drop("n")), ["key", "column"])
        return rows.where((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))

    def add(part: DataFrame) -> None:
        nonlocal found
        found = part if found is None else found.unionByName(part)

    while True:
        few = open_.where(F.col("n") <= small)
        ordered = F.array_sort(F.collect_list("v"))  # at most ``small`` values
        add(stored(inside(few).groupBy(*of, "before").agg(ordered.alias("vs")).select(*of, F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v")), "ranks"))
        open_ = open_.where(F.col("n") > small)
        if open_.isEmpty():
            break
        cuts = inside(open_).groupBy(*of).agg(F.percentile_approx("v", shares, 1000).alias("cuts"))
        cut = stored(open_.join(F.broadcast(cuts), of).withColumn("cuts", F.array_sort(F.array_distinct("cuts"))), "cuts")
        # odd cells are the cuts themselves, even ones lie between them
        cell = F.size(F.filter("cuts", lambda x: x <= F.col("v"))) + F.size(F.filter("cuts", lambda x: x < F.col("v")))
        counts = inside(cut).groupBy(*of, cell.alias("cell")).agg(F.count(F.lit(1)).alias("m"))
        upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*of).orderBy("cell")))  # 2 * RANGE_CUTS rows a rank
        hit = upto.join(F.broadcast(cut.drop("n")), of).withColumn("past", F.col("before") + F.col("upto") - F.col("m"))
        hit = stored(hit.where((F.col("past") <= F.col("rank")) & (F.col("rank") < F.col("past") + F.col("m"))), "cells")
        no = F.expr("cell div 2").cast("int")
        add(hit.where("cell % 2 = 1").select(*of, F.get("cuts", no).alias("v")))
        open_ = hit.where("cell % 2 = 0").select(
            *of, F.col("m").alias("n"), F.col("past").alias("before"),
            F.coalesce(F.when(no > 0, F.get("cuts", no - 1)), "lo").alias("lo"), F.coalesce(F.get("cuts", no), "hi").alias("hi"))
    both = found.join(F.broadcast(large), ["key", "column"]).groupBy("key", "column", "n").agg(
        F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    share = (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return both.select("key", "column", ((F.lit(1.0) - share) * F.col("a") + share * F.col("b")).alias("value"))


#: Share of the values on either side of the median between the first cuts, and the accuracy with which these are found.
NEAR_MEDIAN, CUT_ACCURACY = 0.002, 2_000


def exact_medians(df: DataFrame, cols: Sequence[str], small: int = SMALL_GROUP) -> dict[str, float | None]:
    """The interpolated median of each column (None without values), by numpy's rule as ``group_quantiles``.

    Columns stay side by side: one pass finds two approximate quantiles around each median, one counts
    the values below, on and between them, and one sorts the few between (at most ``small``). A column whose cuts
    miss its median or leave more goes by ``group_quantiles``. The driver sees one row of each pass."""
    names = {c: f"_{i}" for i, c in enumerate(cols)}
    if not names:
        return {}
    wide = stored(df.select(*[F.col(c).cast("double").alias(n) for c, n in names.items()]), "medians")
    counts = wide.agg(*[F.count(n).alias(n) for n in names.values()]).first()
    few = {c: n for c, n in names.items() if counts[n] <= small}
    out = dict.fromkeys(names)
    if few:
        found = wide.agg(*[F.percentile(n, 0.5).alias(n) for n in few.values()]).first()
        out.update({c: found[n] for c, n in few.items()})
    large = {c: n for c, n in names.items() if c not in few}
    if not large:
        return out
    shares = F.array(F.lit(0.5 - NEAR_MEDIAN), F.lit(0.5 + NEAR_MEDIAN))
    cuts = wide.agg(*[F.percentile_approx(n, shares, CUT_ACCURACY).alias(n) for n in large.values()]).first()

    def between(n: str) -> F.Column:
        return (F.col(n) > F.lit(cuts[n][0])) & (F.col(n) < F.lit(cuts[n][1]))

    def number(which: dict[str, F.Column]) -> F.Column:
        return F.struct(*[F.count_if(w).alias(k) for k, w in which.items()])

    where = wide.agg(*[number({"below": F.col(n) < F.lit(cuts[n][0]), "low": F.col(n) == F.lit(cuts[n][0]), "between": between(n),
                               "high": (F.col(n) == F.lit(cuts[n][1])) & F.lit(cuts[n][0] != cuts[n][1])}).alias(n) for n in large.values()]).first()
    ranks = {n: ((counts[n] - 1) // 2, counts[n] // 2) for n in large.values()}
    ends = {n: [sum(where[n][:k + 1]) for k in range(4)] for n in large.values()}  # ranks at which below, low, between and high end
    near = {c: n for c, n in large.items() if ends[n][0] <= ranks[n][0] and ranks[n][1] < ends[n][3] and where[n]["between"] <= small}
    sorted_ = {n: F.array_sort(F.collect_list(F.when(between(n), F.col(n)))) for n in near.values()}
    inner = wide.agg(*[F.array(*[F.get(vs, F.lit(r - ends[n][1]).cast("int")) for r in ranks[n]]).alias(n) for n, vs in sorted_.items()]).first() if near else None
    for c, n in near.items():
        a, b = (cuts[n][0] if r < ends[n][1] else inner[n][k] if r < ends[n][2] else cuts[n][1] for k, r in enumerate(ranks[n]))
        out[c] = a if ranks[n][0] == ranks[n][1] else 0.5 * a + 0.5 * b
    rest = {n: c for c, n in large.items() if c not in near}
    if rest:
        out.update({rest[r["column"]]: r["value"] for r in group_quantiles(wide, [], list(rest), 0.5, small).collect()})
    return out


def value_summary(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row: mean, median, max and population deviation of a column (nulls left out)."""
    df = stored(df.select(F.col(col).cast("double").alias(col)), "summary")
    median = group_quantiles(df, [], [col], 0.5).agg(F.max("value").alias("m"))
    return df.agg(F.avg(col).alias(f"{name}_mean"), F.max(col).alias(f"{name}_max"), F.stddev_pop(col).alias(f"{name}_std")).select(
        f"{name}_mean", median.scalar().alias(f"{name}_median"), f"{name}_max", f"{name}_std")


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL -> column median of ``fit_on`` (default: the full frame), interpolated
    like numpy; a column without values stays NULL."""
    medians = exact_medians(fit_on if fit_on is not None else df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")) for c in cols})


def normalize_minmax(df: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """``(x - min) / (max - min + 1e-9)`` for each column, one aggregate for all. The frame is stored first:
    what derives it runs once."""
    df = stored(df, "unscaled")
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_mn_{c}"), F.max(c).alias(f"_mx_{c}")]
    out = with_scalars(df, df.agg(*aggs))
    for c in cols:
        mn, mx = F.col(f"_mn_{c}"), F.col(f"_mx_{c}")
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - mn) / (mx - mn + F.lit(K.MINMAX_EPS)))
    return out.drop(*[x for c in cols for x in (f"_mn_{c}", f"_mx_{c}")])


def regression_metrics(df: DataFrame, actual: str = "actual", pred: str = "pred",
                       group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSE/SST (not squared correlation)."""
    err = F.col(actual) - F.col(pred)
    g = df.groupBy(*group) if group else df
    agg = g.agg(F.avg(F.abs(err)).alias("mae"),
                F.sqrt(F.avg(err * err)).alias("rmse"),
                F.sum(err * err).alias("_sse"),
                (F.var_pop(actual) * F.count(actual)).alias("_sst"),
                F.count(F.lit(1)).alias("n"))
    r2 = F.lit(1.0) - safe_div("_sse", "_sst")
    return agg.select(*group, "mae", "rmse", r2.alias("r2"), "n")


def residuals(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(pred))


def confusion_matrix(df: DataFrame, actual: str = "actual", pred: str = "pred",
                     threshold: DataFrame | None = None) -> DataFrame:
    """High/low classes at the median of ``actual`` (or a given one-row threshold)."""
    if threshold is None:
        j = df.withColumn("threshold", F.lit(exact_medians(df, [actual])[actual]).cast("double"))
    else:
        j = with_scalars(df, threshold.select("threshold"))
    a = (F.col(actual) > F.col("threshold"))
    p = (F.col(pred) > F.col("threshold"))
    s = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    agg = j.agg(s(~a & ~p).alias("tn"), s(~a & p).alias("fp"), s(a & ~p).alias("fn"),
                s(a & p).alias("tp"), F.max("threshold").alias("threshold"))
    acc = (F.col("tn") + F.col("tp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return agg.withColumn("accuracy", acc)


def histogram_by_group(df: DataFrame, value: str, group: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Equal-width bins between the group's min and max (last bin closed),
    bin counts and the group mean. A constant group spans (x-0.5, x+0.5)."""
    g = list(group)
    stats = df.groupBy(*g).agg(F.min(value).alias("_lo0"), F.max(value).alias("_hi0"),
                               F.avg(value).alias("group_mean"))
    lo = F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0"))
    hi = F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0"))
    stats = stats.select(*g, lo.alias("_lo"), hi.alias("_hi"), "group_mean")
    # Per-group stats are one row per group: bounded by the number of groups.
    j = df.where(F.col(value).isNotNull()).join(small_side(stats, materialize=True), g) if g else \
        with_scalars(df.where(F.col(value).isNotNull()), stats)
    idx = F.floor((F.col(value) - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))
    j = j.withColumn("bin", F.least(idx, F.lit(bins - 1)).cast("int"))
    out = j.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"),
                                   F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                   F.first("group_mean").alias("group_mean"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select(*g, "bin", "count", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                      "group_mean")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, as (f1, f2, corr): one
    aggregate over the upper triangle (the matrix is symmetric), mirrored."""
    n = len(cols)
    aggs = [F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    wide = df.agg(*aggs)

    def cell(i: int, j: int) -> F.Column:
        a, b = (i, j) if i <= j else (j, i)
        return F.col(f"c{a}_{b}")

    pairs = F.array(*[F.struct(F.lit(cols[i]).alias("f1"), F.lit(cols[j]).alias("f2"), cell(i, j).alias("corr"))
                      for i in range(n) for j in range(n)])
    out = wide.select(F.inline(pairs))
    return out.withColumn("corr", F.when(F.isnan("corr"), F.lit(None)).otherwise(F.col("corr")))


def group_quantile_flag(df: DataFrame, score: str, group: Sequence[str], q: float = 0.7,
                        flag: str = "highlight") -> DataFrame:
    """Mark rows at or above the group's q-quantile (linear interpolation). Null groups are a group; a null
    score is not marked."""
    df = stored(df, "scored")
    qs = group_quantiles(df, group, [score], q).select(F.struct(*group).alias("_g"), F.col("value").alias("_q"))
    marked = df.withColumn("_g", F.struct(*group)).join(small_side(qs, materialize=True), "_g", "left")
    return marked.withColumn(flag, F.col(score) >= F.col("_q")).drop("_q", "_g")


def batch_score(df: DataFrame, raw: str = "raw_pred", out: str = "predicted_xP",
                lower: float = K.XP_MIN, upper: float = K.XP_MAX, digits: int = 2) -> DataFrame:
    return df.withColumn(out, round_half_even(clip_col(raw, lower, upper), digits))


def value_score(df: DataFrame, pred: str = "predicted_xP", price: str = "price") -> DataFrame:
    return df.withColumn("value_score", round_half_even(safe_div(pred, price), 3))


def composite_score(df: DataFrame, pred: str = "predicted_xP", value: str = "value_score",
                    form: str = "form", ease: str = "fixture_ease", available: str = "is_available",
                    weights=K.COMPOSITE_WEIGHTS, out: str = "rag_score") -> DataFrame:
    """40 n(pred) + 20 n(value) + 15 n(form) + 15 n(ease) + 10 available, rounded to 2."""
    cols = [pred, value, form, ease]
    n = normalize_minmax(df, cols)
    w = weights
    s = (F.col(f"{pred}_norm") * w[0] + F.col(f"{value}_norm") * w[1] + F.col(f"{form}_norm") * w[2]
         + F.col(f"{ease}_norm") * w[3] + F.col(available).cast("double") * w[4])
    return n.withColumn(out, round_half_even(s, 2)).drop(*[f"{c}_norm" for c in cols])


def classify_advice(xp: str = "xp", position: str = "position_name", has_injury: str = "has_injury_news",
                    is_available: str | None = "is_available", thresholds=K.ADVICE_THRESHOLDS,
                    default_position: str = K.ADVICE_DEFAULT_POSITION) -> F.Column:
    """Injury or unavailable -> avoid; else thresholds by position (>=); unknown -> default."""
    x = F.col(xp)
    pos = F.col(position)
    known = [p for p in thresholds if p != default_position]

    def tier(i: int) -> F.Column:
        t = F.lit(thresholds[default_position][i])
        for p in known:
            t = F.when(pos == F.lit(p), F.lit(thresholds[p][i])).otherwise(t)
        return t

    bad = F.coalesce(F.col(has_injury) == 1, F.lit(False))
    if is_available is not None:
        bad = bad | ~F.coalesce(F.col(is_available), F.lit(True))
    return (F.when(bad, F.lit(K.ADVICE_AVOID_STATUS))
            .when(x >= tier(0), F.lit(K.ADVICE_STRONG))
            .when(x >= tier(1), F.lit(K.ADVICE_GOOD))
            .when(x >= tier(2), F.lit(K.ADVICE_BENCH))
            .otherwise(F.lit(K.ADVICE_AVOID_LOW)))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[F.Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """``row_number() <= n`` per group; Spark inserts a partial WindowGroupLimit
    before the shuffle, so a hot group sends at most n rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def topk_global(df: DataFrame, order: Sequence[F.Column], k: int) -> DataFrame:
    """First k by a total order (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def rank_all(df: DataFrame, order_cols: Sequence, rank_col: str = "rank") -> DataFrame:
    """1-based position in a total order over all rows (range-partitioned numbering)."""
    return assign_row_ids(df, order_cols, start=1, id_col=rank_col)
