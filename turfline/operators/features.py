"""Per-player feature table with the expected-points target (xP).

Plan shape at scale: players are scanned once and never shuffled. Fixtures are
aggregated by team (partial + final hash aggregate); the per-team results and
the team dimension are broadcast after a size probe; global scalars (finished
gameweeks, mean fixture ease) are one-row aggregates cross-joined as broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.functions.columns import (clip_col, keyword_flag, label_map, one_hot, per_90,
                                        right_closed_tier, round_half_even, safe_div)
from turfline.plans.guards import small_side, with_scalars
from turfline.session import stored


# ---------------------------------------------------------------- projections / flags

def map_position(players: DataFrame) -> DataFrame:
    return players.withColumn("position_name", label_map("position", K.POSITION_LABELS))


def derive_price(players: DataFrame) -> DataFrame:
    return players.withColumn("price", F.col("now_cost") / F.lit(10.0))


def flag_available(players: DataFrame, min_chance: int = K.AVAILABLE_MIN_CHANCE) -> DataFrame:
    chance = F.coalesce(F.col("chance_of_playing_next_round"), F.lit(100))
    return players.withColumn("is_available", chance >= F.lit(min_chance))


def flag_injury_news(players: DataFrame, keywords=K.INJURY_KEYWORDS, whole_word: bool = False) -> DataFrame:
    return players.withColumn("has_injury_news", keyword_flag("news", keywords, whole_word))


def flag_on_loan(players: DataFrame) -> DataFrame:
    hit = F.lower(F.col("news")).contains(K.LOAN_KEYWORD)
    return players.withColumn("on_loan", F.coalesce(hit, F.lit(False)).cast("int"))


def flag_active(players: DataFrame) -> DataFrame:
    return players.withColumn("is_active", F.coalesce(F.col("minutes") > 0, F.lit(False)).cast("int"))


def filter_active(players: DataFrame) -> DataFrame:
    return players.where((F.col("minutes") > 0) | (F.col("total_points") > 0))


def add_player_flags(players: DataFrame) -> DataFrame:
    """Position label, price and the four flags."""
    p = map_position(players)
    p = derive_price(p)
    p = flag_available(p)
    p = flag_injury_news(p)
    p = flag_on_loan(p)
    return flag_active(p)


# ---------------------------------------------------------------- fixture aggregates

def split_finished(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    return fixtures.where(F.col("finished") == 1), fixtures.where(F.col("finished") == 0)


def finished_gameweeks(fixtures: DataFrame) -> DataFrame:
    """One row: max(number of distinct finished gameweeks, 1)."""
    fin = fixtures.where(F.col("finished") == 1)
    return fin.agg(F.greatest(F.count_distinct("gameweek"), F.lit(1)).cast("long").alias("finished_gws"))


def team_goal_stats(fixtures: DataFrame) -> DataFrame:
    """Per team over finished fixtures: goals for/against, games, averages.

    Home and away sides are stacked (one narrow union) and aggregated once,
    which is the one-shuffle form of adding the home and away totals."""
    fin = fixtures.where(F.col("finished") == 1)
    home = fin.select(F.col("team_h").alias("team_id"), F.col("team_h_score").alias("gf"),
                      F.col("team_a_score").alias("ga"), F.col("id"))
    away = fin.select(F.col("team_a").alias("team_id"), F.col("team_a_score").alias("gf"),
                      F.col("team_h_score").alias("ga"), F.col("id"))
    g = (home.unionAll(away).where(F.col("team_id").isNotNull())
         .groupBy("team_id")
         .agg(F.coalesce(F.sum("gf"), F.lit(0)).cast("long").alias("team_goals_for"),
              F.coalesce(F.sum("ga"), F.lit(0)).cast("long").alias("team_goals_against"),
              F.count("id").alias("games_played")))
    games = F.greatest(F.col("games_played"), F.lit(1))
    return g.select("team_id", "team_goals_for", "team_goals_against", "games_played",
                    (F.col("team_goals_for") / games).alias("avg_goals_scored"),
                    (F.col("team_goals_against") / games).alias("avg_goals_conceded"))


def fixture_opponents(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """For each upcoming fixture whose two teams are both known: (team, opponent strength)."""
    upcoming = fixtures.where(F.col("finished") == 0)
    t = small_side(teams.select("id", "strength"))
    th = t.select(F.col("id").alias("_h"), F.col("strength").alias("h_strength"))
    ta = t.select(F.col("id").alias("_a"), F.col("strength").alias("a_strength"))
    j = (upcoming.join(th, upcoming.team_h == th._h, "inner")
         .join(ta, upcoming.team_a == ta._a, "inner"))
    pairs = F.array(
        F.struct(F.col("team_h").alias("team_id"), F.col("a_strength").alias("opp_strength")),
        F.struct(F.col("team_a").alias("team_id"), F.col("h_strength").alias("opp_strength")),
    )
    return j.select(F.inline(pairs))


def fixture_difficulty(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Per team: mean opponent strength and number of upcoming fixtures."""
    return (fixture_opponents(fixtures, teams).groupBy("team_id")
            .agg(F.avg("opp_strength").alias("avg_opp_strength"),
                 F.count("opp_strength").alias("fixture_count")))


# ---------------------------------------------------------------- feature table

IDENTITY_COLS = ["id", "web_name", "position_name", "short_name", "total_points", "pts_per_gw"]


def feature_frame(players: DataFrame, teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """All engineered columns (the wide frame) with the target, one row per active player. What the target's
    global mean needs is stored first, so the player side is evaluated once."""
    return add_xp(stored(engineered_columns(players, teams, fixtures), "features"))


def engineered_columns(players: DataFrame, teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The wide frame up to the fixture ease: one pass over the players, joined to small team tables."""
    p = filter_active(add_player_flags(players))

    # Inner join to the team dimension (checked small -> broadcast). Clashing
    # names from the team side get the suffix ``_team``.
    t = teams.select(F.col("id").alias("id_team"), "name", "short_name", "strength")
    p = p.join(small_side(t), p.team_id == t.id_team, "inner")

    p = with_scalars(p, finished_gameweeks(fixtures))
    fgw = F.col("finished_gws")
    # Batched projections (one analysis pass each; later batches read earlier ones).
    p = p.withColumns({
        "appearance_rate": F.col("minutes") / (fgw * F.lit(90.0)),
        "avg_minutes_per_gw": F.col("minutes") / fgw,
        "pts_per_90": per_90("total_points"),
        "pts_per_million": safe_div("total_points", "price"),
        "pts_per_gw": F.col("total_points") / fgw,
        "goal_contributions": F.col("goals_scored") + F.col("assists"),
        "goals_per_90": per_90("goals_scored"),
        "assists_per_90": per_90("assists"),
        "bonus_per_90": per_90("bonus"),
        "cs_per_90": per_90("clean_sheets"),
        "ict_per_90": per_90("ict_index"),
        "form": F.coalesce(F.col("form").try_cast("double"), F.lit(0.0)),
        "ownership": F.coalesce(F.col("selected_by_pct").try_cast("double"), F.lit(0.0)),
    })
    p = p.withColumns({
        "gc_per_90": per_90("goal_contributions"),
        "form_tier": right_closed_tier("form", K.FORM_EDGES, K.FORM_LABELS),
        "ownership_tier": right_closed_tier("ownership", K.OWNERSHIP_EDGES, K.OWNERSHIP_LABELS),
    })

    # Team goal averages: left join, NULL for teams without a finished game.
    ts = team_goal_stats(fixtures).select(
        F.col("team_id").alias("_ts_team"),
        F.col("avg_goals_scored").alias("team_avg_goals_scored"),
        F.col("avg_goals_conceded").alias("team_avg_goals_conceded"))
    p = p.join(small_side(ts, materialize=True), F.col("team_id") == F.col("_ts_team"), "left").drop("_ts_team")

    # Upcoming difficulty: left join, fall back to own strength and 0 fixtures.
    fd = fixture_difficulty(fixtures, teams).withColumnRenamed("team_id", "_fd_team")
    p = p.join(small_side(fd, materialize=True), F.col("team_id") == F.col("_fd_team"), "left").drop("_fd_team")
    p = p.withColumns({
        "avg_opp_strength": F.coalesce(F.col("avg_opp_strength"), F.col("strength").cast("double")),
        "fixture_count": F.coalesce(F.col("fixture_count"), F.lit(0)).cast("long"),
    })
    return p.withColumn("fixture_ease", clip_col(F.lit(K.EASE_BASE) - F.col("avg_opp_strength"), lower=0.0))


def fixture_ease_factor(df: DataFrame) -> DataFrame:
    """factor = ease / max(mean ease over all rows, 1e-9) (global mean as a scalar subquery)."""
    mean = df.agg(F.greatest(F.avg("fixture_ease"), F.lit(K.EASE_EPS)).alias("_mean_ease"))
    return df.withColumn("fixture_ease_factor", F.col("fixture_ease") / mean.scalar())


def add_xp(df: DataFrame) -> DataFrame:
    """xP = round(pts_per_90 * avg_minutes/90 * factor, 2); x0.3 injury; x0.1 unavailable; clamp."""
    p = fixture_ease_factor(df)
    xp = round_half_even(F.col("pts_per_90") * (F.col("avg_minutes_per_gw") / F.lit(90.0))
                         * F.col("fixture_ease_factor"), 2)
    xp = F.when(F.col("has_injury_news") == 1, xp * F.lit(K.INJURY_FACTOR)).otherwise(xp)
    xp = F.when(~F.col("is_available"), xp * F.lit(K.UNAVAILABLE_FACTOR)).otherwise(xp)
    p = p.withColumn(K.TARGET, clip_col(xp, K.XP_MIN, K.XP_MAX))
    return p.select("*", *one_hot("position_name", ["DEF", "FWD", "GKP", "MID"], "pos"))


def feature_table(players: DataFrame, teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """22 features in fixed order, the target and identity columns."""
    return features_of(feature_frame(players, teams, fixtures))


def features_of(wide: DataFrame) -> DataFrame:
    """The feature table of a wide frame."""
    extra = [c for c in [K.TARGET, "web_name", "position_name", "short_name", "price",
                         "total_points", "pts_per_gw"] if c not in K.FEATURE_COLS]
    feats = [F.col(c).cast("double").alias(c) for c in K.FEATURE_COLS]
    return wide.select("id", *feats, *extra)


def feature_rows_for(features: DataFrame, names: DataFrame, name_col: str = "web_name") -> DataFrame:
    """Features of chosen entities only: filter after the global steps (semi join)."""
    return features.join(names.select(name_col).distinct(), on=name_col, how="left_semi")


# ---------------------------------------------------------------- joins and lookups

def join_team_inner(players: DataFrame, teams: DataFrame) -> DataFrame:
    """Inner equi join on team id; unknown teams drop out; clashing names get ``_team``."""
    t = teams.select(F.col("id").alias("id_team"), "name", "short_name", "strength")
    return players.join(small_side(t), players.team_id == t.id_team, "inner")


def lookup_name(players: DataFrame, teams: DataFrame, out: str = "team_name") -> DataFrame:
    """id -> name through the team dimension; unmatched -> NULL (left broadcast join)."""
    t = teams.select(F.col("id").alias("_tid"), F.col("name").alias(out))
    return players.join(small_side(t), players.team_id == t._tid, "left").drop("_tid")


def outer_add(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Per-key total of two sides where a missing side counts as 0: one stacked
    aggregate (a single shuffle) instead of two aggregates and a full outer join."""
    both = left.select(key, value).unionAll(right.select(key, value)).where(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(value))


def fixtures_of_entities(fixtures: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Fixtures where the team is home OR away, for a table of entities.

    Two equi semi joins instead of one OR-join (which would plan as a nested
    loop): home matches, plus away matches whose home side did not match."""
    ent = small_side(entities.select(F.col(key).alias("_e")).distinct())
    home = fixtures.join(ent, fixtures.team_h == ent._e, "left_semi")
    rest = fixtures.join(ent, fixtures.team_h == ent._e, "left_anti")
    away = rest.join(ent, rest.team_a == ent._e, "left_semi")
    return home.unionByName(away)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
        out = row if out is None else out.unionByName(row)
    return out
