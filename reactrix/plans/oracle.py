"""DuckDB text of the shared views, used to check the registered queries."""

from __future__ import annotations

from ..params import BASELINE, DRIVER

_KNOTS = "[" + ", ".join(f"{y}::DOUBLE" for y in BASELINE) + "]"

VIEWS = {
    "items": """
WITH li AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS qa,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS qr,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qn,
         sum(l_quantity) AS q, sum(l_linenumber) AS ln,
         sum(CAST(round(l_discount * 100) AS INT)) AS disc,
         sum(CAST(round(l_tax * 100) AS INT)) AS tax,
         min(l_partkey) AS pk
  FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate,
         CAST(floor(o_totalprice * o_totalprice / 1000) AS BIGINT) AS v FROM orders)
SELECT o_orderkey AS item_id, p_name AS title, o_custkey AS owner_id,
       o_orderpriority AS category, c_mktsegment AS source, o_orderdate AS pub_ts,
       CAST(q * 5 AS BIGINT) AS duration,
       CASE WHEN o_orderkey % 3 = 0 THEN 1080 ELSE 1920 END AS width,
       CASE WHEN o_orderkey % 3 = 0 THEN 1920 ELSE 1080 END AS height,
       CASE WHEN o_orderkey % 10 = 0 THEN 90 ELSE 0 END AS rotate,
       v AS view,
       CAST(floor(v * qa * (1 + o_orderkey % 4) / 2000) AS BIGINT) AS coin,
       CAST(floor(v * qr * (1 + o_orderkey % 5) / 1500) AS BIGINT) AS fav,
       CAST(floor(v * qn / 300) AS BIGINT) AS like_cnt, CAST(floor(v * ln / 2000e0) AS BIGINT) AS danmaku,
       CAST(floor(v * disc / 5000e0) AS BIGINT) AS share, CAST(floor(v * tax / 5000e0) AS BIGINT) AS reply
FROM o JOIN li ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = pk""",
    "scored": f"""
SELECT *, f7 / base AS cbi,
  CASE WHEN view < 3000 THEN 'unproven' WHEN f7 / base >= 3e0 THEN 'high' WHEN f7 / base >= 2e0 THEN 'good'
       WHEN f7 / base >= 1e0 THEN 'normal' WHEN f7 / base >= 0.5e0 THEN 'low' ELSE 'junk' END AS tier
FROM (SELECT * EXCLUDE (k, kn), CASE WHEN lv <= 4.5e0 THEN 0.2065e0 WHEN lv >= 7.2e0 THEN 0.0863e0
        ELSE kn[k + 1] + (lv - (4.5e0 + k * 0.1e0)) / 0.1e0 * (kn[k + 2] - kn[k + 1]) END AS base
  FROM (SELECT *, CAST(least(greatest(floor((lv - 4.5e0) * 10e0), 0), 26) AS INT) AS k, {_KNOTS} AS kn
    FROM (SELECT *, CASE WHEN view > 0 THEN (3e0 * fav + 2e0 * coin + 0.3e0 * like_cnt) / view ELSE 0e0 END AS f7,
        log10(greatest(view, 10)) AS lv, like_cnt::DOUBLE / view AS like_rate, coin::DOUBLE / view AS coin_rate,
        fav::DOUBLE / view AS fav_rate, danmaku::DOUBLE / view AS danmaku_rate, share::DOUBLE / view AS share_rate,
        reply::DOUBLE / view AS reply_rate, (danmaku + share + reply)::DOUBLE / view AS social,
        CAST(year(pub_ts) AS BIGINT) AS year,
        greatest((epoch(TIMESTAMP '{DRIVER.capture_time}') - epoch(pub_ts)) / 86400e0, 0.1e0) AS age
      FROM items)))""",
    "banded": f"""
SELECT * EXCLUDE (is_ref, below), CASE WHEN view >= 3000 AND ref_n >= 3 THEN below::DOUBLE / ref_n END AS pct
FROM (SELECT *, CAST(sum(is_ref) OVER (PARTITION BY band) AS BIGINT) AS ref_n,
    CAST(sum(is_ref) OVER (PARTITION BY band ORDER BY coin_rate RANGE UNBOUNDED PRECEDING)
       - sum(is_ref) OVER (PARTITION BY band, coin_rate) AS BIGINT) AS below
  FROM (SELECT *, CAST(round_even(lv / 0.2e0, 0) AS BIGINT) AS band,
      CASE WHEN pub_ts < TIMESTAMP '{DRIVER.reference_cutoff}' AND view >= 3000 THEN 1 ELSE 0 END AS is_ref
    FROM scored))""",
    "edges": "SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS item_id, l_returnflag AS arm FROM lineitem",
    "related": "SELECT a.item AS src, b.item AS dst FROM members a JOIN members b ON a.part = b.part AND a.item <> b.item",
    "members": "SELECT DISTINCT l_partkey AS part, l_orderkey AS item FROM lineitem",
    "walk_nodes": f"SELECT DISTINCT item AS item_id FROM members WHERE part IN (SELECT part FROM members WHERE item IN (SELECT item_id FROM items WHERE pub_ts < TIMESTAMP '{DRIVER.first_walk}'))",
    "captures": """
SELECT user_id AS item_id, event_id AS capture_id, ts, value AS counter, event_type <> 'error' AS complete,
       event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS extra FROM events""",
}
NEEDS = {"scored": ["items"], "banded": ["scored"], "related": ["members"], "walk_nodes": ["members", "items"]}


def with_views(views, body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prefix a query with the views it uses, dependencies first."""
    extra = extra or {}
    done: list[str] = []

    def add(name):
        if name in done:
            return
        deps, _ = extra.get(name, (NEEDS.get(name, []), None))
        for dep in deps:
            add(dep)
        done.append(name)

    for view in views:
        add(view)
    if not done:
        return body
    text = {n: extra[n][1] if n in extra else VIEWS[n] for n in done}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n == 'related' else ''}({text[n]})" for n in done) + "\n" + body
