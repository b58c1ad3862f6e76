"""Catalog entries: projections, flags, fixture aggregates and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import constants as K
from turfline.operators import features as FT
from turfline.plans.catalog import register
from turfline.sources import fixtures as FX

FEATURE_DOUBLES = list(K.FEATURE_COLS) + ["xP", "pts_per_gw"]

INJ_RE = "|".join(K.INJURY_KEYWORDS)

# Oracle CTE chain for the feature table (DuckDB dialect, same steps in SQL).
ORACLE_FEATURE_CTES = [
    ("o_players", f"""
SELECT *,
  CASE position WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position_name,
  now_cost / 10.0E0 AS price,
  COALESCE(chance_of_playing_next_round, 100) >= 75 AS is_available,
  CAST(COALESCE(regexp_matches(lower(news), '{INJ_RE}'), false) AS INTEGER) AS has_injury_news
FROM fx_players WHERE minutes > 0 OR total_points > 0"""),
    ("o_fgw", """
SELECT GREATEST(COUNT(DISTINCT gameweek), 1) AS finished_gws FROM fx_fixtures WHERE finished = 1"""),
    ("o_ts", """
SELECT team_id, CAST(COALESCE(SUM(gf), 0) AS BIGINT) AS team_goals_for,
       CAST(COALESCE(SUM(ga), 0) AS BIGINT) AS team_goals_against, COUNT(id) AS games_played
FROM (SELECT team_h AS team_id, team_h_score AS gf, team_a_score AS ga, id FROM fx_fixtures WHERE finished = 1
      UNION ALL
      SELECT team_a, team_a_score, team_h_score, id FROM fx_fixtures WHERE finished = 1) s
WHERE team_id IS NOT NULL GROUP BY team_id"""),
    ("o_fd", """
SELECT team_id, AVG(opp_strength) AS avg_opp_strength, COUNT(opp_strength) AS fixture_count
FROM (SELECT f.team_h AS team_id, ta.strength AS opp_strength
      FROM fx_fixtures f JOIN fx_teams th ON f.team_h = th.id JOIN fx_teams ta ON f.team_a = ta.id
      WHERE f.finished = 0
      UNION ALL
      SELECT f.team_a, th.strength
      FROM fx_fixtures f JOIN fx_teams th ON f.team_h = th.id JOIN fx_teams ta ON f.team_a = ta.id
      WHERE f.finished = 0) s
GROUP BY team_id"""),
    ("o_a", """
SELECT p.*, t.short_name, t.strength, g.finished_gws,
  p.minutes / (g.finished_gws * 90.0E0) AS appearance_rate,
  p.minutes / CAST(g.finished_gws AS DOUBLE) AS avg_minutes_per_gw,
  CASE WHEN p.minutes > 0 THEN p.total_points / (p.minutes / 90.0E0) ELSE 0.0E0 END AS pts_per_90,
  p.total_points / CAST(g.finished_gws AS DOUBLE) AS pts_per_gw,
  CASE WHEN p.minutes > 0 THEN (p.goals_scored + p.assists) / (p.minutes / 90.0E0) ELSE 0.0E0 END AS gc_per_90,
  CASE WHEN p.minutes > 0 THEN p.goals_scored / (p.minutes / 90.0E0) ELSE 0.0E0 END AS goals_per_90,
  CASE WHEN p.minutes > 0 THEN p.assists / (p.minutes / 90.0E0) ELSE 0.0E0 END AS assists_per_90,
  CASE WHEN p.minutes > 0 THEN p.bonus / (p.minutes / 90.0E0) ELSE 0.0E0 END AS bonus_per_90,
  CASE WHEN p.minutes > 0 THEN p.clean_sheets / (p.minutes / 90.0E0) ELSE 0.0E0 END AS cs_per_90,
  CASE WHEN p.minutes > 0 THEN p.ict_index / (p.minutes / 90.0E0) ELSE 0.0E0 END AS ict_per_90,
  COALESCE(TRY_CAST(p.form AS DOUBLE), 0.0E0) AS form_v,
  COALESCE(TRY_CAST(p.selected_by_pct AS DOUBLE), 0.0E0) AS ownership,
  ts.avg_goals_scored_t AS team_avg_goals_scored, ts.avg_goals_conceded_t AS team_avg_goals_conceded,
  COALESCE(fd.avg_opp_strength, CAST(t.strength AS DOUBLE)) AS avg_opp_strength,
  CAST(COALESCE(fd.fixture_count, 0) AS BIGINT) AS fixture_count
FROM o_players p
JOIN fx_teams t ON p.team_id = t.id
CROSS JOIN o_fgw g
LEFT JOIN (SELECT team_id, team_goals_for / CAST(GREATEST(games_played, 1) AS DOUBLE) AS avg_goals_scored_t,
                  team_goals_against / CAST(GREATEST(games_played, 1) AS DOUBLE) AS avg_goals_conceded_t
           FROM o_ts) ts ON p.team_id = ts.team_id
LEFT JOIN o_fd fd ON p.team_id = fd.team_id"""),
    ("o_b", """
SELECT *, CASE WHEN avg_opp_strength IS NULL THEN NULL
               WHEN 6.0E0 - avg_opp_strength < 0 THEN 0.0E0 ELSE 6.0E0 - avg_opp_strength END AS fixture_ease
FROM o_a"""),
    ("o_c", """
SELECT o_b.*, fixture_ease / m.mean_ease AS fixture_ease_factor
FROM o_b CROSS JOIN (SELECT GREATEST(AVG(fixture_ease), 1e-9) AS mean_ease FROM o_b) m"""),
    ("o_d", """
SELECT *, round_even(pts_per_90 * (avg_minutes_per_gw / 90.0E0) * fixture_ease_factor, 2) AS xp0 FROM o_c"""),
    ("o_feat", """
SELECT *,
  CASE WHEN xp2 IS NULL THEN NULL WHEN xp2 < 0 THEN 0.0E0 WHEN xp2 > 15 THEN 15.0E0 ELSE xp2 END AS xP,
  CASE WHEN position_name = 'DEF' THEN 1 ELSE 0 END AS pos_DEF,
  CASE WHEN position_name = 'FWD' THEN 1 ELSE 0 END AS pos_FWD,
  CASE WHEN position_name = 'GKP' THEN 1 ELSE 0 END AS pos_GKP,
  CASE WHEN position_name = 'MID' THEN 1 ELSE 0 END AS pos_MID
FROM (SELECT *, CASE WHEN NOT is_available THEN xp1 * 0.1E0 ELSE xp1 END AS xp2
      FROM (SELECT *, CASE WHEN has_injury_news = 1 THEN xp0 * 0.3E0 ELSE xp0 END AS xp1 FROM o_d) u) v"""),
]

FEATURE_SELECT = "SELECT id, " + ", ".join(
    f"CAST({'form_v' if c == 'form' else c} AS DOUBLE) AS {c}" for c in K.FEATURE_COLS
) + ", xP, web_name, position_name, short_name, total_points, pts_per_gw FROM o_feat"

FEATURE_FX = ["fx_players", "fx_teams", "fx_fixtures"]


def _inputs(spark, sf):
    return FX.fx_players(spark, sf), FX.fx_teams(spark, sf), FX.fx_fixtures(spark, sf)


@register("feature_table", oracle=FEATURE_SELECT, fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES,
          rounded=FEATURE_DOUBLES)
def q_feature_table(spark, sf):
    return FT.feature_table(*_inputs(spark, sf))


@register("xp_target", oracle="SELECT id, xP FROM o_feat", fx=FEATURE_FX,
          ctes=ORACLE_FEATURE_CTES, rounded=["xP"])
def q_xp_target(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", "xP")


@register("feature_row_one", oracle=FEATURE_SELECT + " WHERE web_name IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES, rounded=FEATURE_DOUBLES)
def q_feature_row_one(spark, sf):
    from turfline.sources.tables import read_table
    chosen = (read_table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
              .select(F.col("c_name").alias("web_name")))
    return FT.feature_rows_for(FT.feature_table(*_inputs(spark, sf)), chosen)


# ---------------------------------------------------------------- projections and flags

POS_CASE = "CASE position WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END"


@register("map_position", oracle=f"SELECT id, {POS_CASE} AS position_name FROM fx_players", fx=["fx_players"])
def q_map_position(spark, sf):
    return FT.map_position(FX.fx_players(spark, sf)).select("id", "position_name")


@register("derive_price", oracle="SELECT id, now_cost / 10.0E0 AS price FROM fx_players", fx=["fx_players"],
          rounded=["price"])
def q_derive_price(spark, sf):
    return FT.derive_price(FX.fx_players(spark, sf)).select("id", "price")


@register("flag_available", oracle="""
SELECT id, COALESCE(chance_of_playing_next_round, 100) >= 75 AS is_available FROM fx_players""", fx=["fx_players"])
def q_flag_available(spark, sf):
    return FT.flag_available(FX.fx_players(spark, sf)).select("id", "is_available")


@register("flag_injury_news", oracle=f"""
SELECT id, CAST(COALESCE(regexp_matches(lower(news), '{INJ_RE}'), false) AS INTEGER) AS has_injury_news
FROM fx_players""", fx=["fx_players"])
def q_flag_injury_news(spark, sf):
    return FT.flag_injury_news(FX.fx_players(spark, sf)).select("id", "has_injury_news")


@register("flag_on_loan", oracle="""
SELECT id, CAST(COALESCE(contains(lower(news), 'loan'), false) AS INTEGER) AS on_loan FROM fx_players""",
          fx=["fx_players"])
def q_flag_on_loan(spark, sf):
    return FT.flag_on_loan(FX.fx_players(spark, sf)).select("id", "on_loan")


@register("flag_active", oracle="SELECT id, CAST(COALESCE(minutes > 0, false) AS INTEGER) AS is_active FROM fx_players",
          fx=["fx_players"])
def q_flag_active(spark, sf):
    return FT.flag_active(FX.fx_players(spark, sf)).select("id", "is_active")


@register("filter_active", oracle="SELECT id, minutes, total_points FROM fx_players WHERE minutes > 0 OR total_points > 0",
          fx=["fx_players"])
def q_filter_active(spark, sf):
    return FT.filter_active(FX.fx_players(spark, sf)).select("id", "minutes", "total_points")


@register("filter_entity", oracle="""
SELECT id, team_h, team_a FROM fx_fixtures
WHERE team_h IN (SELECT id FROM fx_teams WHERE strength = 5) OR team_a IN (SELECT id FROM fx_teams WHERE strength = 5)""",
          fx=["fx_fixtures", "fx_teams"])
def q_filter_entity(spark, sf):
    chosen = FX.fx_teams(spark, sf).where(F.col("strength") == 5).select("id")
    return FT.fixtures_of_entities(FX.fx_fixtures(spark, sf), chosen).select("id", "team_h", "team_a")


@register("split_finished", oracle="""
SELECT id, CASE WHEN finished = 1 THEN 'finished' ELSE 'upcoming' END AS status FROM fx_fixtures WHERE finished IN (0, 1)""",
          fx=["fx_fixtures"])
def q_split_finished(spark, sf):
    fin, up = FT.split_finished(FX.fx_fixtures(spark, sf))
    return (fin.select("id", F.lit("finished").alias("status"))
            .unionAll(up.select("id", F.lit("upcoming").alias("status"))))


@register("coerce_numeric", oracle="""
SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*([^}]*)', 1) AS BIGINT) AS k_long,
       TRY_CAST(regexp_extract(props, ':\\s*([^}]*)', 1) AS DOUBLE) AS k_double,
       TRY_CAST(event_type AS DOUBLE) AS type_num
FROM events""", rounded=["k_double", "type_num"])
def q_coerce_numeric(spark, sf):
    from turfline.sources.tables import read_table
    from turfline.functions.columns import lenient_cast
    ev = read_table(spark, sf, "events")
    raw = F.regexp_extract("props", r":\s*([^}]*)", 1)
    return ev.select("event_id", lenient_cast(raw, "bigint").alias("k_long"),
                     lenient_cast(raw, "double").alias("k_double"),
                     lenient_cast("event_type", "double").alias("type_num"))


@register("field_fallback", oracle="""
SELECT id, COALESCE(news, '') AS news_text, COALESCE(NULLIF(TRIM(news), ''), web_name) AS label FROM fx_players""",
          fx=["fx_players"])
def q_field_fallback(spark, sf):
    from turfline.functions.columns import blank_to_null
    p = FX.fx_players(spark, sf)
    return p.select("id", F.coalesce("news", F.lit("")).alias("news_text"),
                    F.coalesce(blank_to_null("news"), F.col("web_name")).alias("label"))


PER90 = ["pts_per_90", "goals_per_90", "assists_per_90", "gc_per_90", "bonus_per_90", "cs_per_90", "ict_per_90"]


@register("rates_per_90", oracle="SELECT id, " + ", ".join(PER90) + " FROM o_a", fx=FEATURE_FX,
          ctes=ORACLE_FEATURE_CTES[:5], rounded=PER90)
def q_rates_per_90(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", *PER90)


GW_RATES = ["appearance_rate", "avg_minutes_per_gw", "pts_per_gw", "pts_per_million"]


@register("rates_per_gameweek", oracle="""
SELECT id, appearance_rate, avg_minutes_per_gw, pts_per_gw,
       CASE WHEN price = 0 THEN NULL ELSE total_points / price END AS pts_per_million FROM o_a""",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES[:5], rounded=GW_RATES)
def q_rates_per_gameweek(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", *GW_RATES)


def _tier_sql(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} END"


@register("tier_form", oracle=f"SELECT id, form_v AS form, {_tier_sql('form_v', K.FORM_EDGES, K.FORM_LABELS)} AS form_tier FROM o_a",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES[:5], rounded=["form"])
def q_tier_form(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", "form", "form_tier")


@register("tier_ownership", oracle=f"SELECT id, ownership, {_tier_sql('ownership', K.OWNERSHIP_EDGES, K.OWNERSHIP_LABELS)} AS ownership_tier FROM o_a",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES[:5], rounded=["ownership"])
def q_tier_ownership(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", "ownership", "ownership_tier")


@register("clip_range", oracle="""
SELECT id, CASE WHEN form IS NULL THEN NULL WHEN form < 0 THEN 0.0E0 WHEN form > 5 THEN 5.0E0 ELSE form END AS form_clipped
FROM fx_players""", fx=["fx_players"], rounded=["form_clipped"])
def q_clip_range(spark, sf):
    from turfline.functions.columns import clip_col
    return FX.fx_players(spark, sf).select("id", clip_col("form", 0.0, 5.0).alias("form_clipped"))


@register("round_half_even", oracle="""
SELECT id, round_even(raw_pred / 8.0E0, 2) AS r2, round_even(actual / 16.0E0, 3) AS r3 FROM fx_scored""",
          fx=["fx_scored"], rounded=["r2", "r3"])
def q_round_half_even(spark, sf):
    from turfline.functions.columns import round_half_even
    s = FX.fx_scored(spark, sf)
    return s.select("id", round_half_even(F.col("raw_pred") / 8.0, 2).alias("r2"),
                    round_half_even(F.col("actual") / 16.0, 3).alias("r3"))


@register("one_hot_position", oracle=f"""
SELECT id, CASE WHEN pn = 'DEF' THEN 1 ELSE 0 END AS pos_DEF, CASE WHEN pn = 'FWD' THEN 1 ELSE 0 END AS pos_FWD,
       CASE WHEN pn = 'GKP' THEN 1 ELSE 0 END AS pos_GKP, CASE WHEN pn = 'MID' THEN 1 ELSE 0 END AS pos_MID
FROM (SELECT id, {POS_CASE} AS pn FROM fx_players) t""", fx=["fx_players"])
def q_one_hot_position(spark, sf):
    from turfline.functions.columns import one_hot
    p = FT.map_position(FX.fx_players(spark, sf))
    return p.select("id", *one_hot("position_name", ["DEF", "FWD", "GKP", "MID"], "pos"))


@register("require_columns", oracle="SELECT id, " + ", ".join(
    (f"CAST({'form_v' if c == 'form' else c} AS DOUBLE) AS {c}" if i < 10 else f"0.0E0 AS {c}")
    for i, c in enumerate(K.FEATURE_COLS)) + " FROM o_feat",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES, rounded=list(K.FEATURE_COLS))
def q_require_columns(spark, sf):
    from turfline.operators.ml import require_columns
    partial = FT.feature_table(*_inputs(spark, sf)).select("id", *K.FEATURE_COLS[:10])
    return require_columns(partial, K.FEATURE_COLS, fill=True).select("id", *K.FEATURE_COLS)


# ---------------------------------------------------------------- joins

@register("join_team_inner", oracle="""
SELECT p.id, p.web_name, t.id AS id_team, t.name, t.short_name, t.strength FROM fx_players p JOIN fx_teams t ON p.team_id = t.id""",
          fx=["fx_players", "fx_teams"])
def q_join_team_inner(spark, sf):
    return FT.join_team_inner(FX.fx_players(spark, sf), FX.fx_teams(spark, sf)).select(
        "id", "web_name", "id_team", "name", "short_name", "strength")


@register("join_team_stats_left", oracle="""
SELECT id, team_avg_goals_scored, team_avg_goals_conceded, avg_opp_strength, fixture_count FROM o_a""",
          fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES[:5],
          rounded=["team_avg_goals_scored", "team_avg_goals_conceded", "avg_opp_strength"])
def q_join_team_stats_left(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select(
        "id", "team_avg_goals_scored", "team_avg_goals_conceded", "avg_opp_strength", "fixture_count")


@register("lookup_name", oracle="""
SELECT p.id, t.name AS team_name FROM fx_players p LEFT JOIN fx_teams t ON p.team_id = t.id""",
          fx=["fx_players", "fx_teams"])
def q_lookup_name(spark, sf):
    return FT.lookup_name(FX.fx_players(spark, sf), FX.fx_teams(spark, sf)).select("id", "team_name")


@register("outer_add", oracle="""
SELECT COALESCE(h.team, a.team) AS team_id, COALESCE(h.g, 0) + COALESCE(a.g, 0) AS goals_for
FROM (SELECT team_h AS team, CAST(SUM(team_h_score) AS BIGINT) AS g FROM fx_fixtures WHERE finished = 1 GROUP BY team_h) h
FULL OUTER JOIN (SELECT team_a AS team, CAST(SUM(team_a_score) AS BIGINT) AS g FROM fx_fixtures WHERE finished = 1 GROUP BY team_a) a
  ON h.team = a.team""", fx=["fx_fixtures"])
def q_outer_add(spark, sf):
    fin = FX.fx_fixtures(spark, sf).where(F.col("finished") == 1)
    return FT.outer_add(fin.select(F.col("team_h").alias("team_id"), F.col("team_h_score").alias("g")),
                        fin.select(F.col("team_a").alias("team_id"), F.col("team_a_score").alias("g")),
                        "team_id", "g").withColumnRenamed("g", "goals_for")


@register("fixture_opponent_join", oracle="""
SELECT f.team_h AS team_id, ta.strength AS opp_strength
FROM fx_fixtures f JOIN fx_teams th ON f.team_h = th.id JOIN fx_teams ta ON f.team_a = ta.id WHERE f.finished = 0
UNION ALL
SELECT f.team_a, th.strength
FROM fx_fixtures f JOIN fx_teams th ON f.team_h = th.id JOIN fx_teams ta ON f.team_a = ta.id WHERE f.finished = 0""",
          fx=["fx_fixtures", "fx_teams"])
def q_fixture_opponent_join(spark, sf):
    return FT.fixture_opponents(FX.fx_fixtures(spark, sf), FX.fx_teams(spark, sf))


@register("scalar_crossjoin", oracle="SELECT id, fixture_ease_factor FROM o_c", fx=FEATURE_FX,
          ctes=ORACLE_FEATURE_CTES[:7], rounded=["fixture_ease_factor"])
def q_scalar_crossjoin(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", "fixture_ease_factor")


# ---------------------------------------------------------------- aggregates

@register("team_goal_stats", oracle="""
SELECT team_id, team_goals_for, team_goals_against, games_played,
       team_goals_for / CAST(GREATEST(games_played, 1) AS DOUBLE) AS avg_goals_scored,
       team_goals_against / CAST(GREATEST(games_played, 1) AS DOUBLE) AS avg_goals_conceded FROM o_ts""",
          fx=["fx_fixtures"], ctes=[c for c in ORACLE_FEATURE_CTES if c[0] == "o_ts"],
          rounded=["avg_goals_scored", "avg_goals_conceded"])
def q_team_goal_stats(spark, sf):
    return FT.team_goal_stats(FX.fx_fixtures(spark, sf))


@register("fixture_difficulty", oracle="SELECT team_id, avg_opp_strength, fixture_count FROM o_fd",
          fx=["fx_fixtures", "fx_teams"], ctes=[c for c in ORACLE_FEATURE_CTES if c[0] == "o_fd"],
          rounded=["avg_opp_strength"])
def q_fixture_difficulty(spark, sf):
    return FT.fixture_difficulty(FX.fx_fixtures(spark, sf), FX.fx_teams(spark, sf))


@register("fixture_ease", oracle="SELECT id, fixture_ease, fixture_ease_factor FROM o_c", fx=FEATURE_FX,
          ctes=ORACLE_FEATURE_CTES[:7], rounded=["fixture_ease", "fixture_ease_factor"])
def q_fixture_ease(spark, sf):
    return FT.feature_frame(*_inputs(spark, sf)).select("id", "fixture_ease", "fixture_ease_factor")


@register("finished_gameweeks", oracle="SELECT CAST(finished_gws AS BIGINT) AS finished_gws FROM o_fgw",
          fx=["fx_fixtures"], ctes=[c for c in ORACLE_FEATURE_CTES if c[0] == "o_fgw"])
def q_finished_gameweeks(spark, sf):
    return FT.finished_gameweeks(FX.fx_fixtures(spark, sf))


@register("table_profile", oracle="""
SELECT 'players' AS table_name, COUNT(*) AS n_rows, 16 AS n_cols FROM fx_players
UNION ALL SELECT 'teams', COUNT(*), 4 FROM fx_teams
UNION ALL SELECT 'fixtures', COUNT(*), 8 FROM fx_fixtures""", fx=["fx_players", "fx_teams", "fx_fixtures"])
def q_table_profile(spark, sf):
    return FT.table_profile({"players": FX.fx_players(spark, sf), "teams": FX.fx_teams(spark, sf),
                             "fixtures": FX.fx_fixtures(spark, sf)})


@register("scan_project", oracle="SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000")
def q_scan_project(spark, sf):
    from turfline.sources.tables import scan_project
    return scan_project(spark, sf, "documents", ["doc_id", "lang", "n_chars"]).where(F.col("n_chars") > 1000)
