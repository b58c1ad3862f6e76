"""Plan checks: pruning and pushdown reach the scan, top-k per group is pruned
before the shuffle, the player side of the feature table is not shuffled, and
no Python UDF runs outside the vectorised operators."""
from pyspark.sql import functions as F

from turfline.operators import features as FT
from turfline.operators import scoring as SC
from turfline.sources import fixtures as FX
from turfline.sources.tables import scan_project

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = scan_project(spark, SF, "documents", ["doc_id", "lang"]).where(F.col("doc_id") > 5)
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_top_n_per_group_uses_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("g"), "id")
    top = SC.top_n_per_group(df, ["g"], [F.col("id").desc()], 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(top)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_feature_table_does_not_shuffle_players(spark):
    ft = FT.engineered_columns(FX.fx_players(spark, SF), FX.fx_teams(spark, SF), FX.fx_fixtures(spark, SF))
    p = ft._jdf.queryExecution().optimizedPlan().toString()
    phys = _plan(ft)
    assert "SortMergeJoin" not in phys
    assert "BroadcastHashJoin" in phys or "BroadcastNestedLoopJoin" in phys
    assert p  # plan builds


def test_feature_table_has_no_cross_join(spark):
    """Global scalars arrive as scalar subqueries, not as joins of every row."""
    ft = FT.engineered_columns(FX.fx_players(spark, SF), FX.fx_teams(spark, SF), FX.fx_fixtures(spark, SF))
    phys = _plan(ft)
    assert "CartesianProduct" not in phys and "BroadcastNestedLoopJoin" not in phys
    assert "Subquery" in phys


def test_no_row_at_a_time_python_udf_in_feature_table(spark):
    ft = FT.engineered_columns(FX.fx_players(spark, SF), FX.fx_teams(spark, SF), FX.fx_fixtures(spark, SF))
    p = _plan(ft)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_composite_score_evaluates_the_players_once(spark):
    """What derives the frame has one scan of the players; means, minima and maxima read the stored frame."""
    from turfline.plans.queries.q_scoring import enriched

    ft = FT.engineered_columns(FX.fx_players(spark, SF), FX.fx_teams(spark, SF), FX.fx_fixtures(spark, SF))
    assert ft._jdf.queryExecution().optimizedPlan().toString().count("c_custkey#") and _plan(ft).count("customer.parquet") == 1
    final = enriched(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" not in final and "orders.parquet" not in final


def test_nothing_stays_cached(spark):
    from turfline.plans.catalog import load_all

    reg = load_all()
    for key in ("rank_enriched", "rolling_form", "retrieve_hybrid", "insert_if_absent"):
        reg[key].query(spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_watermark_filter_reaches_the_scan(spark):
    from turfline.operators.upsert import incremental_since_watermark

    news = FX.fx_news(spark, SF)
    p = _plan(incremental_since_watermark(news, 123).select("id"))
    assert "GreaterThan(doc_id,123)" in p


def test_trailing_frames_use_no_entity_window(spark):
    from turfline.operators.windows import last_n_turns

    h = last_n_turns(FX.fx_queries(spark, SF), 4)
    p = h._jdf.queryExecution().optimizedPlan().toString()
    # the only window is over the per-partition counts (no entity key)
    assert "conv_id" not in "".join(line for line in p.splitlines() if "Window [" in line)


def test_upsert_is_partial_aggregate(spark):
    from turfline.operators.upsert import latest_by_key

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(latest_by_key(FX.fx_history_raw(spark, SF), ["player_id", "round"], ["seq"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # map-side partial aggregate before the exchange, then the final one
    assert p.index("partial_max_by") > p.index("Exchange hashpartitioning")
    assert "Window" not in p
