"""Catalog entries: scores, advice, rankings, metrics, imputation and splits.

Predictions in the oracle-checked keys are the stand-in ``fx_scored.raw_pred``
(tree outputs are checked rows-only in ``q_ml``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import constants as K
from turfline.functions.columns import keyword_flag, label_map, round_half_even
from turfline.operators import features as FT
from turfline.operators import ml as ML
from turfline.operators import scoring as SC
from turfline.plans.catalog import register
from turfline.plans.queries.q_features import FEATURE_FX, ORACLE_FEATURE_CTES, _inputs
from turfline.sources import fixtures as FX

ENR_FX = FEATURE_FX + ["fx_scored"]

ENRICHED_CTES = ORACLE_FEATURE_CTES + [
    ("o_enr", """
SELECT f.id, f.web_name, f.position_name, f.short_name, f.price, f.team_id, f.ownership,
       f.form_v AS form, f.minutes, f.fixture_ease, f.is_available, f.has_injury_news,
       f.total_points, f.avg_opp_strength, f.fixture_count,
       round_even(CASE WHEN s.raw_pred < 0 THEN 0.0E0 WHEN s.raw_pred > 15 THEN 15.0E0
                       ELSE s.raw_pred END, 2) AS predicted_xP
FROM o_feat f JOIN fx_scored s ON f.id = s.id"""),
    ("o_val", "SELECT *, round_even(predicted_xP / price, 3) AS value_score FROM o_enr"),
    ("o_rag", """
SELECT v.*, round_even(
    (predicted_xP - m.mn_p) / (m.mx_p - m.mn_p + 1e-9) * 40.0E0
  + (value_score - m.mn_v) / (m.mx_v - m.mn_v + 1e-9) * 20.0E0
  + (form - m.mn_f) / (m.mx_f - m.mn_f + 1e-9) * 15.0E0
  + (fixture_ease - m.mn_e) / (m.mx_e - m.mn_e + 1e-9) * 15.0E0
  + CAST(is_available AS DOUBLE) * 10.0E0, 2) AS rag_score
FROM o_val v CROSS JOIN (SELECT MIN(predicted_xP) mn_p, MAX(predicted_xP) mx_p, MIN(value_score) mn_v,
                                MAX(value_score) mx_v, MIN(form) mn_f, MAX(form) mx_f,
                                MIN(fixture_ease) mn_e, MAX(fixture_ease) mx_e FROM o_val) m"""),
]


def enriched(spark, sf):
    """Feature rows next to stand-in predictions, with value and composite scores."""
    wide = FT.feature_frame(*_inputs(spark, sf))
    scored = FX.fx_scored(spark, sf).select("id", "raw_pred")
    e = ML.enrich_join(wide, scored, key="id")
    e = SC.batch_score(e)
    e = SC.value_score(e)
    return SC.composite_score(e)


@register("enrich_join", oracle="SELECT id, web_name, position_name, short_name, price, form, predicted_xP FROM o_enr",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["price", "form", "predicted_xP"])
def q_enrich_join(spark, sf):
    return enriched(spark, sf).select("id", "web_name", "position_name", "short_name", "price",
                                      "form", "predicted_xP")


@register("batch_score", oracle="""
SELECT id, round_even(CASE WHEN raw_pred < 0 THEN 0.0E0 WHEN raw_pred > 15 THEN 15.0E0 ELSE raw_pred END, 2)
       AS predicted_xP FROM fx_scored""", fx=["fx_scored"], rounded=["predicted_xP"])
def q_batch_score(spark, sf):
    return SC.batch_score(FX.fx_scored(spark, sf)).select("id", "predicted_xP")


@register("value_score", oracle="SELECT id, predicted_xP, price, value_score FROM o_val",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["predicted_xP", "price", "value_score"])
def q_value_score(spark, sf):
    return enriched(spark, sf).select("id", "predicted_xP", "price", "value_score")


@register("normalize_minmax", oracle="""
SELECT id, (predicted_xP - mn_p) / (mx_p - mn_p + 1e-9) AS pred_norm,
           (form - mn_f) / (mx_f - mn_f + 1e-9) AS form_norm
FROM o_val CROSS JOIN (SELECT MIN(predicted_xP) mn_p, MAX(predicted_xP) mx_p,
                              MIN(form) mn_f, MAX(form) mx_f FROM o_val) m""",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["pred_norm", "form_norm"])
def q_normalize_minmax(spark, sf):
    e = enriched(spark, sf)
    n = SC.normalize_minmax(e, ["predicted_xP", "form"])
    return n.select("id", F.col("predicted_xP_norm").alias("pred_norm"), "form_norm")


@register("composite_score", oracle="SELECT id, rag_score FROM o_rag", fx=ENR_FX,
          ctes=ENRICHED_CTES, rounded=["rag_score"])
def q_composite_score(spark, sf):
    return enriched(spark, sf).select("id", "rag_score")


ADVICE_SQL_CASE = """
CASE WHEN COALESCE(has_injury_news = 1, false) OR NOT COALESCE(is_available, true) THEN '{avoid_s}'
     WHEN xp >= CASE pos WHEN 'GKP' THEN 5.0E0 WHEN 'DEF' THEN 5.5E0 WHEN 'FWD' THEN 6.5E0 ELSE 6.0E0 END THEN '{strong}'
     WHEN xp >= CASE pos WHEN 'GKP' THEN 3.5E0 WHEN 'DEF' THEN 3.5E0 WHEN 'FWD' THEN 4.5E0 ELSE 4.0E0 END THEN '{good}'
     WHEN xp >= CASE pos WHEN 'GKP' THEN 2.0E0 WHEN 'DEF' THEN 2.0E0 WHEN 'FWD' THEN 2.5E0 ELSE 2.5E0 END THEN '{bench}'
     ELSE '{avoid_l}' END""".format(avoid_s=K.ADVICE_AVOID_STATUS, strong=K.ADVICE_STRONG,
                                   good=K.ADVICE_GOOD, bench=K.ADVICE_BENCH, avoid_l=K.ADVICE_AVOID_LOW)

INJ_RE = "|".join(K.INJURY_KEYWORDS)


@register("classify_advice", oracle=f"""
SELECT id, xp, {ADVICE_SQL_CASE} AS advice
FROM (SELECT s.id, s.raw_pred AS xp,
             CASE p.position WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS pos,
             CAST(COALESCE(regexp_matches(lower(p.news), '{INJ_RE}'), false) AS INTEGER) AS has_injury_news,
             COALESCE(p.chance_of_playing_next_round, 100) >= 75 AS is_available
      FROM fx_scored s JOIN fx_players p ON s.id = p.id) t""",
          fx=["fx_scored", "fx_players"], rounded=["xp"])
def q_classify_advice(spark, sf):
    p = FX.fx_players(spark, sf)
    s = FX.fx_scored(spark, sf).select("id", F.col("raw_pred").alias("xp"))
    j = s.join(p.select("id", "position", "news", "chance_of_playing_next_round"), "id")
    j = j.select("id", "xp", label_map("position", K.POSITION_LABELS).alias("position_name"),
                 keyword_flag("news", K.INJURY_KEYWORDS).alias("has_injury_news"),
                 (F.coalesce("chance_of_playing_next_round", F.lit(100)) >= 75).alias("is_available"))
    return j.select("id", "xp", SC.classify_advice().alias("advice"))


@register("advice_table", oracle=f"""
SELECT ROW_NUMBER() OVER (ORDER BY rag_score DESC, id) AS listing_no, id, web_name, short_name,
       position_name AS pos_label, price, round_even(xp, 1) AS xp_1dp,
       {ADVICE_SQL_CASE.replace('NOT COALESCE(is_available, true)', 'false')} AS advice
FROM (SELECT *, predicted_xP AS xp, position_name AS pos FROM o_rag) t""",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["price", "xp_1dp"])
def q_advice_table(spark, sf):
    e = enriched(spark, sf).withColumn("xp", F.col("predicted_xP"))
    e = e.withColumn("advice", SC.classify_advice(is_available=None))
    ranked = SC.rank_all(e, [F.col("rag_score").desc(), F.col("id")], rank_col="listing_no")
    return ranked.select("listing_no", "id", "web_name", "short_name",
                         F.col("position_name").alias("pos_label"), "price",
                         round_half_even("xp", 1).alias("xp_1dp"), "advice")


@register("rank_enriched", oracle="SELECT id, rag_score, ROW_NUMBER() OVER (ORDER BY rag_score DESC, id) AS rank FROM o_rag",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["rag_score"])
def q_rank_enriched(spark, sf):
    e = enriched(spark, sf).select("id", "rag_score")
    return SC.rank_all(e, [F.col("rag_score").desc(), F.col("id")])


@register("numbered_listing", oracle="SELECT id, web_name, ROW_NUMBER() OVER (ORDER BY web_name, id) AS listing_no FROM o_rag",
          fx=ENR_FX, ctes=ENRICHED_CTES)
def q_numbered_listing(spark, sf):
    e = enriched(spark, sf).select("id", "web_name")
    return SC.rank_all(e, ["web_name", "id"], rank_col="listing_no")


@register("topk_global", oracle="SELECT id, web_name, rag_score FROM o_rag ORDER BY rag_score DESC, id LIMIT 10",
          fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["rag_score"])
def q_topk_global(spark, sf):
    e = enriched(spark, sf)
    return SC.topk_global(e, [F.col("rag_score").desc(), F.col("id")], 10).select("id", "web_name", "rag_score")


@register("top_n_per_group", oracle="""
SELECT position_name, id, rag_score, rank FROM (
  SELECT position_name, id, rag_score,
         ROW_NUMBER() OVER (PARTITION BY position_name ORDER BY rag_score DESC, id) AS rank
  FROM o_rag WHERE position_name IS NOT NULL) t
WHERE rank <= 10""", fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["rag_score"])
def q_top_n_per_group(spark, sf):
    # Groups are the four known positions (an unknown position has no listing).
    e = enriched(spark, sf).where(F.col("position_name").isNotNull()).select("position_name", "id", "rag_score")
    return SC.top_n_per_group(e, ["position_name"], [F.col("rag_score").desc(), F.col("id")], 10)


@register("group_quantile_flag", oracle="""
SELECT t.position_name, t.id, t.rag_score, t.rag_score >= q.q70 AS highlight FROM (
  SELECT position_name, id, rag_score,
         ROW_NUMBER() OVER (PARTITION BY position_name ORDER BY rag_score DESC, id) AS rank
  FROM o_rag WHERE position_name IS NOT NULL) t
JOIN (SELECT position_name, quantile_cont(rag_score, 0.7) AS q70 FROM (
        SELECT position_name, rag_score,
               ROW_NUMBER() OVER (PARTITION BY position_name ORDER BY rag_score DESC, id) AS rank
        FROM o_rag WHERE position_name IS NOT NULL) u
      WHERE rank <= 10 GROUP BY position_name) q
  ON t.position_name IS NOT DISTINCT FROM q.position_name
WHERE t.rank <= 10""", fx=ENR_FX, ctes=ENRICHED_CTES, rounded=["rag_score"])
def q_group_quantile_flag(spark, sf):
    e = enriched(spark, sf).where(F.col("position_name").isNotNull()).select("position_name", "id", "rag_score")
    top = SC.top_n_per_group(e, ["position_name"], [F.col("rag_score").desc(), F.col("id")], 10).drop("rank")
    return SC.group_quantile_flag(top, "rag_score", ["position_name"], 0.7)


@register("regression_metrics", oracle="""
SELECT AVG(ABS(actual - raw_pred)) AS mae, SQRT(AVG((actual - raw_pred) * (actual - raw_pred))) AS rmse,
       1 - SUM((actual - raw_pred) * (actual - raw_pred)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
       COUNT(*) AS n
FROM fx_scored""", fx=["fx_scored"], rounded=["mae", "rmse", "r2"])
def q_regression_metrics(spark, sf):
    return SC.regression_metrics(FX.fx_scored(spark, sf), "actual", "raw_pred")


@register("confusion_matrix", oracle="""
SELECT CAST(SUM(CASE WHEN NOT a AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(SUM(CASE WHEN NOT a AND p THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN a AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN a AND p THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       MAX(threshold) AS threshold,
       (SUM(CASE WHEN NOT a AND NOT p THEN 1 ELSE 0 END) + SUM(CASE WHEN a AND p THEN 1 ELSE 0 END))
         / CAST(COUNT(*) AS DOUBLE) AS accuracy
FROM (SELECT actual > m AS a, raw_pred > m AS p, m AS threshold
      FROM fx_scored CROSS JOIN (SELECT MEDIAN(actual) AS m FROM fx_scored) mm) t""",
          fx=["fx_scored"], rounded=["threshold", "accuracy"])
def q_confusion_matrix(spark, sf):
    return SC.confusion_matrix(FX.fx_scored(spark, sf), "actual", "raw_pred")


@register("residuals", oracle="""
SELECT id, actual - raw_pred AS residual, AVG(actual - raw_pred) OVER () AS mean_residual FROM fx_scored""",
          fx=["fx_scored"], rounded=["residual", "mean_residual"])
def q_residuals(spark, sf):
    s = SC.residuals(FX.fx_scored(spark, sf), "actual", "raw_pred")
    from turfline.plans.guards import with_scalars
    mean = s.agg(F.avg("residual").alias("mean_residual"))
    return with_scalars(s, mean).select("id", "residual", "mean_residual")


@register("histogram_by_group", oracle="""
SELECT position_name, bin, COUNT(*) AS count, FIRST(lo) + bin * ((FIRST(hi) - FIRST(lo)) / 20.0E0) AS bin_lo,
       FIRST(group_mean) AS group_mean
FROM (SELECT position_name, lo, hi, group_mean,
             CAST(LEAST(FLOOR((xP - lo) * 20.0E0 / (hi - lo)), 19) AS INTEGER) AS bin
      FROM (SELECT f.position_name, f.xP,
                   CASE WHEN s.lo0 = s.hi0 THEN s.lo0 - 0.5 ELSE s.lo0 END AS lo,
                   CASE WHEN s.lo0 = s.hi0 THEN s.hi0 + 0.5 ELSE s.hi0 END AS hi, s.group_mean
            FROM o_feat f JOIN (SELECT position_name, MIN(xP) lo0, MAX(xP) hi0, AVG(xP) group_mean
                                FROM o_feat WHERE position_name IS NOT NULL GROUP BY position_name) s
              ON f.position_name = s.position_name
            WHERE f.xP IS NOT NULL) a) b
GROUP BY position_name, bin""", fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES,
          rounded=["bin_lo", "group_mean:4"])
def q_histogram_by_group(spark, sf):
    wide = (FT.feature_frame(*_inputs(spark, sf)).where(F.col("position_name").isNotNull())
            .select("position_name", "xP"))
    return SC.histogram_by_group(wide, "xP", ["position_name"], 20)


IMPUTE_COLS = ["team_avg_goals_scored", "team_avg_goals_conceded"]


@register("impute_median", oracle="""
SELECT id, COALESCE(team_avg_goals_scored, m1) AS team_avg_goals_scored,
           COALESCE(team_avg_goals_conceded, m2) AS team_avg_goals_conceded
FROM o_feat CROSS JOIN (SELECT MEDIAN(team_avg_goals_scored) m1, MEDIAN(team_avg_goals_conceded) m2 FROM o_feat) m""",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES, rounded=IMPUTE_COLS)
def q_impute_median(spark, sf):
    ft = FT.feature_table(*_inputs(spark, sf))
    return SC.impute_median(ft, IMPUTE_COLS).select("id", *IMPUTE_COLS)


CORR_COLS = K.FEATURE_COLS[:12]


def _corr_oracle() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            ca = "form_v" if a == "form" else a
            cb = "form_v" if b == "form" else b
            parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, corr(CAST({ca} AS DOUBLE), CAST({cb} AS DOUBLE)) AS c FROM imp")
    body = "\nUNION ALL ".join(parts)
    imp_cols = ", ".join(
        f"COALESCE(CAST({'form_v' if c == 'form' else c} AS DOUBLE), MEDIAN(CAST({'form_v' if c == 'form' else c} AS DOUBLE)) OVER ()) AS {'form_v' if c == 'form' else c}"
        for c in CORR_COLS)
    return (f"SELECT f1, f2, CASE WHEN isnan(c) THEN NULL ELSE c END AS corr FROM (\n"
            f"WITH imp AS (SELECT {imp_cols} FROM o_feat)\n{body}) z")


@register("correlation_matrix", oracle=_corr_oracle(), fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES,
          rounded=["corr"])
def q_correlation_matrix(spark, sf):
    ft = SC.impute_median(FT.feature_table(*_inputs(spark, sf)), CORR_COLS)
    return SC.correlation_matrix(ft, CORR_COLS)


@register("xp_summary", oracle="""
SELECT AVG(xP) AS xp_mean, MEDIAN(xP) AS xp_median, MAX(xP) AS xp_max, STDDEV_POP(xP) AS xp_std FROM o_feat""",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES, rounded=["xp_mean", "xp_median", "xp_max", "xp_std"])
def q_xp_summary(spark, sf):
    return SC.value_summary(FT.feature_table(*_inputs(spark, sf)), "xP", "xp")


@register("train_test_split", oracle=f"""
SELECT id, (((id % 2147483648) * 1103515245 + 12345 + {K.SPLIT_SEED}) % 2147483648) % 100 < {int(K.TEST_FRACTION * 100)} AS is_test
FROM o_feat""", fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES)
def q_train_test_split(spark, sf):
    ft = FT.feature_table(*_inputs(spark, sf))
    return ML.train_test_split(ft, "id").select("id", "is_test")


def _standardize_oracle() -> str:
    cols = []
    for c in K.FEATURE_COLS:
        src = "form_v" if c == "form" else c
        cols.append(f"(CAST({src} AS DOUBLE) - AVG(CASE WHEN NOT is_test THEN CAST({src} AS DOUBLE) END) OVER ()) / "
                    f"COALESCE(NULLIF(STDDEV_POP(CASE WHEN NOT is_test THEN CAST({src} AS DOUBLE) END) OVER (), 0), 1.0E0) AS z_{c}")
    return (f"SELECT id, {', '.join(cols)} FROM (SELECT *, (((id % 2147483648) * 1103515245 + 12345 + {K.SPLIT_SEED}) % 2147483648) % 100 "
            f"< {int(K.TEST_FRACTION * 100)} AS is_test FROM o_feat) t")


@register("standardize", oracle=_standardize_oracle(), fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES,
          rounded=[f"z_{c}" for c in K.FEATURE_COLS])
def q_standardize(spark, sf):
    ft = ML.train_test_split(FT.feature_table(*_inputs(spark, sf)), "id")
    z = ML.standardize(ft, K.FEATURE_COLS, fit_on=ft.where(~F.col("is_test")))
    return z.select("id", *[F.col(c).alias(f"z_{c}") for c in K.FEATURE_COLS])


@register("residual_histogram", oracle="""
SELECT bin, COUNT(*) AS count, FIRST(lo) + bin * ((FIRST(hi) - FIRST(lo)) / 30.0E0) AS bin_lo, FIRST(m) AS group_mean
FROM (SELECT r, lo, hi, m, CAST(LEAST(FLOOR((r - lo) * 30.0E0 / (hi - lo)), 29) AS INTEGER) AS bin
      FROM (SELECT actual - raw_pred AS r FROM fx_scored) x
      CROSS JOIN (SELECT CASE WHEN MIN(actual - raw_pred) = MAX(actual - raw_pred) THEN MIN(actual - raw_pred) - 0.5
                              ELSE MIN(actual - raw_pred) END AS lo,
                         CASE WHEN MIN(actual - raw_pred) = MAX(actual - raw_pred) THEN MAX(actual - raw_pred) + 0.5
                              ELSE MAX(actual - raw_pred) END AS hi,
                         AVG(actual - raw_pred) AS m FROM fx_scored) s) b
GROUP BY bin""", fx=["fx_scored"], rounded=["bin_lo", "group_mean:4"])
def q_residual_histogram(spark, sf):
    # The residual view: 30 equal-width bins over all rows, plus the mean.
    r = SC.residuals(FX.fx_scored(spark, sf), "actual", "raw_pred").select("residual")
    return SC.histogram_by_group(r, "residual", [], 30)
