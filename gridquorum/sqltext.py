"""Common table expressions that the SQL equivalents share."""

CELLS = """
cells AS (
  SELECT event_type AS var, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS g, CAST(user_id % 8 AS INTEGER) AS x,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM events GROUP BY 1, 2, 3),
g0 AS (SELECT min(g) AS g0 FROM cells)"""

REPLICAS = CELLS + """,
layouts(holder, layout, stride, soff, ct, tile) AS (
  VALUES ('A', '24x8+0', 1, 0, 24, 8), ('B', '4x8+0s6o0', 6, 0, 4, 8), ('C', '168x4+0', 1, 0, 168, 4), ('D', '24x8+0', 1, 0, 24, 8)),
held AS (
  SELECT 'A' AS holder, var, g, x, cents FROM cells, g0 WHERE g < g0 + 480
  UNION ALL SELECT 'B', var, g, x, cents FROM cells, g0 WHERE g >= g0 + 240 AND g % 6 = 0
  UNION ALL SELECT 'C', var, g, x, cents FROM cells WHERE g % 5 <> 0
  UNION ALL SELECT 'D', var, g, x, CASE WHEN g % 24 = 0 THEN cents + 100000 ELSE cents END FROM cells, g0 WHERE g < g0 + 480),
replicas AS (
  SELECT l.*, h.var, h.g, h.x, h.cents, h.cents / 100::DOUBLE AS value,
    CAST(floor((h.g - l.soff) / l.stride::DOUBLE / l.ct) AS BIGINT) AS c, CAST(h.x // l.tile AS INTEGER) AS t
  FROM held h JOIN layouts l USING (holder))"""

CHUNKS = REPLICAS + """,
chunks AS (
  SELECT holder, layout, var, c, t, stride, soff, ct, tile, count(*) AS n, count(DISTINCT g) AS nvalid, CAST(sum(cents) AS BIGINT) AS cents,
    min(g) AS g0, max(g) + 1 AS g1, md5(string_agg(g || ':' || x || ':' || cents, ',' ORDER BY g, x, cents)) AS vcid, count(*) * 8 AS size
  FROM replicas GROUP BY ALL)"""

UNION = REPLICAS + """,
merged AS (
  SELECT var, g, x, arg_min(holder, rank) AS holder, arg_min(cents, rank) AS cents FROM (
    SELECT *, CASE holder WHEN 'A' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS rank FROM replicas WHERE holder IN ('A', 'B', 'C'))
  GROUP BY var, g, x)"""

ISLANDS = """
  SELECT {keys}, min(g0) AS g0, max(g1) AS g1 FROM (
    SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY g0, g1 ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN max(g1) OVER w IS NULL OR g0 > max(g1) OVER w THEN 1 ELSE 0 END AS new FROM ({spans})
      WINDOW w AS (PARTITION BY {keys} ORDER BY g0, g1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  GROUP BY {keys}, run"""


VOTE = """,
vals AS (
  SELECT var, layout, c, t, vcid, CAST(sum({trust}) AS BIGINT) AS trust, count(*) AS votes, max(nvalid) AS nvalid, string_agg(holder, '+' ORDER BY holder) AS src
  FROM chunks GROUP BY var, layout, c, t, vcid),
ranked AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY var, layout, c, t) AS k,
    lead(trust) OVER w AS trust2, lead(votes) OVER w AS votes2, lead(nvalid) OVER w AS nvalid2
  FROM vals WINDOW w AS (PARTITION BY var, layout, c, t ORDER BY trust DESC, votes DESC, nvalid DESC, vcid DESC)),
won AS (
  SELECT *, CASE WHEN k = 1 THEN 'accepted' WHEN trust = trust2 AND votes = votes2 AND nvalid = nvalid2 THEN 'contested'
    WHEN trust = trust2 AND votes = votes2 THEN 'rival' ELSE 'accepted' END AS status FROM ranked WHERE rn = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
