"""SQL text for the DuckDB oracle.

The driver registers only its own tables, so every oracle string carries the
fixture views it needs as a ``WITH`` chain (definitions as in FIXTURES.md).
"""

from __future__ import annotations

FX_SQL: dict[str, str] = {
    "fx_teams": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
       'T' || CAST(n_nationkey AS VARCHAR(10)) AS short_name,
       CAST(1 + (n_nationkey * 7) % 5 AS BIGINT) AS strength
FROM nation""",
    "fx_history_raw": """
SELECT o_custkey AS player_id,
       CAST((EXTRACT(YEAR FROM o_orderdate) - 1995) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS round,
       o_orderkey AS seq,
       CAST(FLOOR(o_totalprice) AS BIGINT) % 16 AS total_points,
       o_orderkey % 3 AS goals_scored, o_orderkey % 4 AS assists,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS clean_sheets,
       o_orderkey % 91 AS minutes, o_orderkey % 4 AS bonus, (o_orderkey * 13) % 60 AS bps
FROM orders""",
    "fx_player_history": """
SELECT player_id, round, seq, total_points, goals_scored, assists, clean_sheets, minutes, bonus, bps
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, round ORDER BY seq DESC) AS rn
      FROM fx_history_raw) t
WHERE rn = 1""",
    "fx_players": """
SELECT c.c_custkey AS id, c.c_name AS web_name,
       CAST(CASE WHEN c.c_custkey % 101 = 100 THEN 99 ELSE c.c_nationkey END AS BIGINT) AS team_id,
       CASE WHEN c.c_custkey % 97 = 0 THEN 5 ELSE 1 + c.c_custkey % 4 END AS position,
       CASE WHEN c.c_custkey % 53 = 0 THEN 0 ELSE COALESCE(h.total_points, 0) END AS total_points,
       40 + c.c_custkey % 90 AS now_cost,
       CAST((c.c_custkey * 37) % 1000 AS DOUBLE) / 10.0 AS selected_by_pct,
       CASE WHEN c.c_custkey % 53 = 0 OR c.c_custkey % 59 = 0 THEN 0 ELSE COALESCE(h.minutes, 0) END AS minutes,
       COALESCE(h.goals_scored, 0) AS goals_scored, COALESCE(h.assists, 0) AS assists,
       COALESCE(h.clean_sheets, 0) AS clean_sheets, COALESCE(h.bonus, 0) AS bonus,
       CASE WHEN c.c_custkey % 89 = 0 THEN NULL ELSE c.c_acctbal / 1000.0 END AS form,
       CAST(COALESCE(h.bps, 0) AS DOUBLE) / 10.0 AS ict_index,
       CASE c.c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 50 WHEN 3 THEN 75 ELSE 100 END
         AS chance_of_playing_next_round,
       CASE c.c_custkey % 11 WHEN 0 THEN 'Hamstring injury - 50% chance of playing'
            WHEN 1 THEN 'Joined on loan' WHEN 2 THEN 'Will return soon' WHEN 3 THEN NULL ELSE '' END AS news
FROM customer c
LEFT JOIN (SELECT player_id, CAST(SUM(total_points) AS BIGINT) AS total_points,
                  CAST(SUM(goals_scored) AS BIGINT) AS goals_scored, CAST(SUM(assists) AS BIGINT) AS assists,
                  CAST(SUM(clean_sheets) AS BIGINT) AS clean_sheets, CAST(SUM(minutes) AS BIGINT) AS minutes,
                  CAST(SUM(bonus) AS BIGINT) AS bonus, CAST(SUM(bps) AS BIGINT) AS bps
           FROM fx_player_history GROUP BY player_id) h
  ON h.player_id = c.c_custkey""",
    "fx_fixtures": """
SELECT id, gameweek, kickoff_time, team_h, (team_h + 1 + id % 22) % 23 AS team_a,
       CASE WHEN finished = 1 THEN id % 5 END AS team_h_score,
       CASE WHEN finished = 1 THEN (id * 3) % 4 END AS team_a_score, finished
FROM (SELECT o_orderkey AS id,
             CAST((EXTRACT(YEAR FROM o_orderdate) - 1995) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS gameweek,
             o_orderdate AS kickoff_time, o_custkey % 23 AS team_h,
             CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished
      FROM orders) f""",
    "fx_news": """
SELECT doc_id AS id, source, SUBSTR(text, 1, 60) AS title, MD5(text) AS url, text AS body
FROM documents""",
    "fx_names": """
SELECT w AS web_name, MIN(item_id * 100000 + p) AS id,
       CASE WHEN MIN(item_id * 100000 + p) % 5 = 0 THEN 0 ELSE MIN(item_id * 100000 + p) % 91 END AS minutes
FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM benchmark) t
WHERE length(w) >= 3 GROUP BY w""",
    "fx_queries": """
SELECT conv_id * 100 + turn AS query_id, conv_id, turn, role, text AS query
FROM conversations""",
    "fx_scored": """
SELECT id, position,
       CASE WHEN id % 71 = 0 THEN 18.0E0 ELSE CAST((id * 7) % 81 AS DOUBLE) / 10.0E0 - 0.5E0 END AS raw_pred,
       CAST((id * 11) % 80 AS DOUBLE) / 10.0E0 AS actual
FROM fx_players""",
}

FX_DEPS: dict[str, list[str]] = {
    "fx_teams": [],
    "fx_history_raw": [],
    "fx_player_history": ["fx_history_raw"],
    "fx_players": ["fx_player_history"],
    "fx_fixtures": [],
    "fx_news": [],
    "fx_names": [],
    "fx_queries": [],
    "fx_scored": ["fx_players"],
}

FX_ORDER = ["fx_teams", "fx_history_raw", "fx_player_history", "fx_players", "fx_fixtures",
            "fx_news", "fx_names", "fx_queries", "fx_scored"]


def _closure(names: list[str]) -> list[str]:
    need: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(FX_DEPS[n])
    return [n for n in FX_ORDER if n in need]


def with_fx(names: list[str], body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture definitions it needs (plus extra CTEs)."""
    parts = [f"{n} AS ({FX_SQL[n]}\n)" for n in _closure(names)]
    parts += [f"{n} AS ({sql}\n)" for n, sql in (extra_ctes or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
