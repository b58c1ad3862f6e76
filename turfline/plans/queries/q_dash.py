"""Catalog entries: search, comparisons, dashboards, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import features as FT
from turfline.operators import scoring as SC
from turfline.operators import serve as SV
from turfline.operators.upsert import first_by_key
from turfline.plans.catalog import register
from turfline.sources import fixtures as FX
from turfline.sources.tables import read_table


@register("player_history_series", oracle="""
SELECT player_id, round, total_points, goals_scored, assists, minutes FROM fx_player_history""",
          fx=["fx_player_history"])
def q_player_history_series(spark, sf):
    return SV.player_history_series(FX.fx_player_history(spark, sf))


@register("rolling_form", oracle="""
SELECT player_id, round, total_points,
       CASE WHEN COUNT(*) OVER w = 3 THEN SUM(total_points) OVER w / 3.0E0 END AS form3
FROM fx_player_history WINDOW w AS (PARTITION BY player_id ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
          fx=["fx_player_history"], rounded=["form3"])
def q_rolling_form(spark, sf):
    return SV.rolling_form(FX.fx_player_history(spark, sf))


@register("best_gameweek", oracle="""
SELECT player_id, round AS best_round, total_points AS best_points FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY total_points DESC, round) AS rn
  FROM fx_player_history) t WHERE rn = 1""", fx=["fx_player_history"])
def q_best_gameweek(spark, sf):
    return SV.best_gameweek(FX.fx_player_history(spark, sf))


@register("player_summary", oracle="""
SELECT player_id, round_even(AVG(total_points), 2) AS avg_points, CAST(SUM(goals_scored) AS BIGINT) AS total_goals,
       CAST(SUM(assists) AS BIGINT) AS total_assists FROM fx_player_history GROUP BY player_id""",
          fx=["fx_player_history"], rounded=["avg_points"])
def q_player_summary(spark, sf):
    return SV.player_summary(FX.fx_player_history(spark, sf))


@register("player_dashboard", oracle="""
WITH f AS (SELECT player_id, round,
                  CASE WHEN COUNT(*) OVER w = 3 THEN SUM(total_points) OVER w / 3.0E0 END AS form3
           FROM fx_player_history WINDOW w AS (PARTITION BY player_id ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
     b AS (SELECT player_id, round AS best_round, total_points AS best_points FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY total_points DESC, round) AS rn
             FROM fx_player_history) t WHERE rn = 1),
     s AS (SELECT player_id, round_even(AVG(total_points), 2) AS avg_points,
                  CAST(SUM(goals_scored) AS BIGINT) AS total_goals, CAST(SUM(assists) AS BIGINT) AS total_assists
           FROM fx_player_history GROUP BY player_id),
     l AS (SELECT player_id, arg_max(form3, round) AS last_form3, COUNT(*) AS n_rounds FROM f GROUP BY player_id)
SELECT l.player_id, l.last_form3, l.n_rounds, b.best_round, b.best_points, s.avg_points, s.total_goals, s.total_assists
FROM l JOIN b ON l.player_id = b.player_id JOIN s ON l.player_id = s.player_id""",
          fx=["fx_player_history"], rounded=["last_form3", "avg_points"])
def q_player_dashboard(spark, sf):
    return SV.player_dashboard(FX.fx_player_history(spark, sf))


@register("first_per_name", oracle="""
SELECT web_name, arg_min(id, id) AS id FROM fx_players GROUP BY web_name""", fx=["fx_players"])
def q_first_per_name(spark, sf):
    return first_by_key(FX.fx_players(spark, sf).select("web_name", "id"), ["web_name"], ["id"])


@register("distinct_names", oracle="SELECT DISTINCT web_name FROM fx_players", fx=["fx_players"])
def q_distinct_names(spark, sf):
    return FX.fx_players(spark, sf).select("web_name").distinct()


SEARCH_SQL = """
SELECT pattern, rank, id, web_name, team_name, goals_scored, assists, total_points,
       COALESCE(form, 0.0E0) / 10.0E0 AS progress
FROM (SELECT p.*, t.name AS team_name, q.pattern,
             ROW_NUMBER() OVER (PARTITION BY q.pattern ORDER BY p.id) AS rank
      FROM fx_players p LEFT JOIN fx_teams t ON p.team_id = t.id
      JOIN (SELECT DISTINCT lower(n_name) AS pattern FROM nation UNION SELECT DISTINCT lower(substr(c_name, 14)) FROM customer) q
        ON contains(lower(p.web_name), q.pattern) OR COALESCE(contains(lower(t.name), q.pattern), false)) z
WHERE rank <= 10"""


def search_patterns(spark, sf):
    """Search terms: every nation's name, and the last digits of every customer's."""
    n, c = read_table(spark, sf, "nation"), read_table(spark, sf, "customer")
    return n.select(F.col("n_name").alias("pattern")).union(c.select(F.expr("substr(c_name, 14)"))).distinct()


@register("search_entities", oracle=SEARCH_SQL, fx=["fx_players", "fx_teams"], rounded=["progress"])
def q_search_entities(spark, sf):
    players = FT.lookup_name(FX.fx_players(spark, sf), FX.fx_teams(spark, sf))
    return SV.search_entities(players, search_patterns(spark, sf))


@register("compare_players", oracle="""
WITH top2 AS (SELECT team_id, id, web_name, goals_scored, assists, total_points, form,
                     ROW_NUMBER() OVER (PARTITION BY team_id ORDER BY total_points DESC, id) AS rk
              FROM fx_players),
     pairs AS (SELECT a.team_id AS pair_id, a.id AS p1, b.id AS p2 FROM top2 a JOIN top2 b
               ON a.team_id = b.team_id AND a.rk = 1 AND b.rk = 2),
     long AS (SELECT id, web_name, 'Goals' AS metric, CAST(goals_scored AS DOUBLE) AS value FROM fx_players
              UNION ALL SELECT id, web_name, 'Assists', CAST(assists AS DOUBLE) FROM fx_players
              UNION ALL SELECT id, web_name, 'Points', CAST(total_points AS DOUBLE) FROM fx_players
              UNION ALL SELECT id, web_name, 'Form', CAST(form AS DOUBLE) FROM fx_players)
SELECT p.pair_id, a.metric, a.web_name AS player1, a.value AS player1_value, b.web_name AS player2,
       b.value AS player2_value
FROM pairs p JOIN long a ON a.id = p.p1 JOIN long b ON b.id = p.p2 AND b.metric = a.metric""",
          fx=["fx_players"], rounded=["player1_value", "player2_value"])
def q_compare_players(spark, sf):
    p = FX.fx_players(spark, sf)
    top2 = SC.top_n_per_group(p.select("team_id", "id", "total_points"), ["team_id"],
                              [F.col("total_points").desc(), F.col("id")], 2, rank_col="rk")
    a = top2.where(F.col("rk") == 1).select(F.col("team_id").alias("pair_id"), F.col("id").alias("p1"))
    b = top2.where(F.col("rk") == 2).select(F.col("team_id").alias("pair_id"), F.col("id").alias("p2"))
    return SV.compare_players(p, a.join(b, "pair_id"))
