"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

NET = """
flows AS (
  SELECT s_nationkey::BIGINT AS u, c_nationkey::BIGINT AS v, sum(l_quantity)::DOUBLE AS capacity,
    round(sum(l_extendedprice) / count(*) / 1000, 6) AS free_flow_time, count(DISTINCT l_orderkey) AS orders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
links AS (
  SELECT (row_number() OVER (ORDER BY u, v) - 1)::BIGINT AS link_id, u, v, capacity, free_flow_time
  FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY capacity DESC, v) AS r FROM flows) WHERE r <= 3),
demand AS (
  SELECT (row_number() OVER (ORDER BY u, v) - 1)::BIGINT AS trip_id, u AS source, v AS target, orders::DOUBLE AS volume FROM flows),
flowing AS (SELECT links.*, orders::DOUBLE AS flow FROM links JOIN flows USING (u, v))
"""

#: All simple paths of up to eight links, and the best path of every trip.
WALKS = """
walk(source, node, dist, path, seen) AS (
  SELECT DISTINCT u, u, 0.0::DOUBLE, []::BIGINT[], [u] FROM links
  UNION ALL
  SELECT source, l.v, dist + l.free_flow_time, list_append(path, l.link_id), list_append(seen, l.v)
  FROM walk JOIN links l ON l.u = node WHERE NOT list_contains(seen, l.v) AND len(path) < 8),
best AS (SELECT source, node, min(dist) AS dist, arg_min(path, dist) AS path FROM walk WHERE source <> node GROUP BY ALL),
found AS (SELECT d.*, b.dist AS cost, b.path AS path FROM demand d LEFT JOIN best b ON b.source = d.source AND b.node = d.target),
loaded AS (
  SELECT links.*, coalesce(f.flow, 0.0) AS flow
  FROM links LEFT JOIN (SELECT link_id, sum(volume) AS flow FROM (SELECT unnest(path) AS link_id, volume FROM found) GROUP BY 1) f USING (link_id)),
costed AS (SELECT *, free_flow_time * (1 + 0.15 * power(flow / capacity, 4)) AS cost FROM loaded),
numbered AS (
  SELECT (row_number() OVER (ORDER BY trip_id) - 1)::BIGINT AS path_id, trip_id, path FROM found WHERE path IS NOT NULL)
"""

REACH = """
reach(a, b) AS (SELECT u, v FROM links UNION SELECT a, v FROM reach JOIN links ON u = b),
ends AS (SELECT u AS node FROM links UNION SELECT v FROM links),
mutual AS (
  SELECT node, least(node, min(r.b)) AS component FROM ends
  LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = node GROUP BY node),
named AS (SELECT node, coalesce(component, node) AS component FROM mutual),
largest AS (SELECT component FROM named GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
core AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::BIGINT AS node_id FROM named JOIN largest USING (component))
"""


def net(sql: str) -> str:
    return f"WITH {NET} {sql}"


def walks(sql: str) -> str:
    return f"WITH RECURSIVE {NET}, {WALKS} {sql}"


def reach(sql: str) -> str:
    return f"WITH RECURSIVE {NET}, {REACH} {sql}"


CELLS = "cells AS (SELECT source AS i, target AS j, volume AS value FROM demand UNION ALL SELECT source, target, volume FROM demand WHERE volume > 1)"
TEXT = "array_to_string(path, '-')"
NEAREST = """
WITH points AS (SELECT c_custkey::BIGINT AS point_id, c_acctbal::DOUBLE AS x, (c_custkey % 100)::DOUBLE AS y FROM customer),
nodes AS (SELECT s_suppkey::BIGINT AS node_id, s_acctbal::DOUBLE AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier)
SELECT point_id, node_id FROM (
  SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY power(p.x - n.x, 2) + power(p.y - n.y, 2), node_id) AS r
  FROM points p CROSS JOIN nodes n) WHERE r = 1
"""
BPR_COST = "round(free_flow_time * (1 + {weight} * power(flow / capacity, 4)), 6) AS cost"



#: The coefficients of the slope along ``d`` as a polynomial of the step.
BPR_SLOPE = ", ".join(
    f"sum(free_flow_time * {{weight}} * {(1, 4, 6, 4, 1)[j]} * power(flow / capacity, {4 - j}) * power(d / capacity, {j}) * d{' + free_flow_time * d' if j == 0 else ''}) AS c{j}" for j in range(5)
)


def halving(k: int) -> str:
    """The WITH clause ``halve<k>`` of the line search on ``slope<k>``."""
    slope = "c0 + a * (c1 + a * (c2 + a * (c3 + a * c4)))"
    return f"""halve{k}(low, high, value, a, n) AS (
  SELECT 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0
  UNION ALL
  SELECT CASE WHEN v < 0 THEN a ELSE low END, CASE WHEN v < 0 THEN high ELSE a END, v, a, n + 1
  FROM (SELECT low, high, n, a, {slope} AS v FROM (SELECT low, high, n, 0.5 * (low + high) AS a FROM halve{k} WHERE (high - low > 1e-6 OR value > 0) AND n < 200), slope{k}))"""


#: The same for costs of free_flow_time / 1000 a unit of flow on top of capacity / 1000.
LINEAR_SLOPE = "sum((free_flow_time / 1000 * flow + capacity / 1000) * d) AS c0, sum(free_flow_time / 1000 * d * d) AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4"


def solver(steps: int, weight: float | None) -> str:
    """WITH clauses that unroll the Frank-Wolfe method: ``state<k>`` (link_id, flow, cost) and ``load<k>`` (trip_id, path) of each step.

    BPR costs of that weight, or the linear ones of LINEAR_SLOPE without one.

    Every simple path of up to eight links is priced anew in each step; the slope of the
    line search is a polynomial of the step whose coefficients are sums over the links.
    """
    price = "free_flow_time / 1000 * {flow} + capacity / 1000" if weight is None else f"free_flow_time * (1 + {weight} * power({{flow}} / capacity, 4))"
    terms = LINEAR_SLOPE if weight is None else BPR_SLOPE.format(weight=weight)
    parts = [
        f"""simple AS MATERIALIZED (SELECT row_number() OVER () AS p, source, node, path FROM walk WHERE source <> node AND len(path) > 0),
used AS MATERIALIZED (SELECT p, unnest(path) AS link_id FROM simple),
wanted AS MATERIALIZED (SELECT trip_id, source, target, volume FROM found WHERE path IS NOT NULL)"""
    ]
    costs = f"SELECT link_id, {price.format(flow='0.0::DOUBLE')} AS cost FROM links"
    for k in range(steps + 1):
        parts.append(
            f"""load{k} AS MATERIALIZED (
  SELECT trip_id, volume, path, dist FROM wanted JOIN (
    SELECT source AS start, node, min(dist) AS dist, arg_min(path, dist) AS path
    FROM simple JOIN (SELECT p, sum(cost) AS dist FROM used JOIN ({costs}) USING (link_id) GROUP BY p) USING (p) GROUP BY ALL) ON node = target AND start = source),
flow{k} AS MATERIALIZED (
  SELECT links.*, coalesce(f.y, 0.0) AS y FROM links LEFT JOIN (SELECT link_id, sum(volume) AS y FROM (SELECT unnest(path) AS link_id, volume FROM load{k}) GROUP BY 1) f USING (link_id))"""
        )
        if k == 0:
            parts.append(f"state0 AS MATERIALIZED (SELECT link_id, capacity, free_flow_time, y::DOUBLE AS flow, {price.format(flow='y')} AS cost FROM flow0)")
            parts.append("step0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS step, NULL::DOUBLE AS gap)")
        else:
            parts.append(
                f"""moving{k} AS MATERIALIZED (SELECT s.*, y - flow AS d FROM state{k - 1} s JOIN flow{k} USING (link_id)),
slope{k} AS MATERIALIZED (SELECT {terms} FROM moving{k}),
{halving(k)},
step{k} AS MATERIALIZED (
  SELECT arg_max(a, n) AS step, (SELECT (SELECT sum(flow * cost) FROM state{k - 1}) - sum(volume * dist) FROM load{k}) / (SELECT sum(volume) FROM wanted) AS gap FROM halve{k}),
state{k} AS MATERIALIZED (SELECT link_id, capacity, free_flow_time, flow, {price.format(flow='flow')} AS cost FROM (SELECT link_id, capacity, free_flow_time, flow + step * d AS flow FROM moving{k}, step{k}))"""
            )
        costs = f"SELECT link_id, cost FROM state{k}"
    return walks(", " + ",\n".join(parts))


def shares(steps: int) -> str:
    """The share of each loading in the flow after the last step."""
    left = [f"(SELECT step FROM step{k})" + "".join(f" * (1 - (SELECT step FROM step{j}))" for j in range(k + 1, steps + 1)) for k in range(steps + 1)]
    return " UNION ALL ".join(f"SELECT trip_id, path, volume * {x} AS flow FROM load{k}" for k, x in enumerate(left))


SOLVED = "SELECT link_id, round(flow, 6) AS flow, round(cost, 6) AS cost FROM state10"
ORACLES = {
    "frank_wolfe_ue": solver(10, 0.15) + f" {SOLVED}",
    "frank_wolfe_so": solver(10, 0.75) + f" {SOLVED}",
    "frank_wolfe_improve": solver(10, 0.15) + f" {SOLVED}",
    "frank_wolfe_gaps": solver(4, 0.15) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS iteration, round(gap, 4) + 0.0 AS gap FROM step{k}" for k in range(1, 5)),
    "path_flows": solver(3, 0.15)
    + f""", paths AS (SELECT trip_id, path, sum(flow) AS flow FROM ({shares(3)}) GROUP BY ALL)
        SELECT (row_number() OVER (ORDER BY trip_id, '[' || array_to_string(path, ',') || ']') - 1)::BIGINT AS col, trip_id, array_to_string(path, '-') AS links, round(flow, 6) AS flow FROM paths""",
    "fleet_size": solver(3, 0.15)
    + """, kept AS (SELECT trip_id, volume, path FROM load0 UNION SELECT trip_id, volume, path FROM load1 UNION SELECT trip_id, volume, path FROM load2 UNION SELECT trip_id, volume, path FROM load3),
        timed AS (SELECT trip_id, volume, path, sum(cost) AS t FROM (SELECT *, unnest(path) AS link_id FROM kept) JOIN state3 USING (link_id) GROUP BY ALL)
        SELECT 'optimal' AS status, round(sum(volume * t) / sum(volume), 4) AS time_a_trip FROM (SELECT trip_id, volume, min(t) AS t FROM timed GROUP BY ALL)""",
    "fleet_relocation": net(
        """, ends AS (SELECT source AS node, -volume AS x FROM demand UNION ALL SELECT target, volume FROM demand),
        surplus AS (SELECT n_nationkey AS node, coalesce(sum(x), 0) AS s FROM nation LEFT JOIN ends ON node = n_nationkey GROUP BY 1)
        SELECT 'optimal' AS status, sum(abs(c))::BIGINT AS moves FROM (SELECT sum(s) OVER (ORDER BY node) AS c FROM surplus)"""
    ),
    "path_flow_residual": "SELECT 0.0::DOUBLE AS residual",
    "linear_equilibrium": solver(10, None) + f" {SOLVED}",
    "network_links": net("SELECT * FROM links"),
    "node_index": net("SELECT node, (row_number() OVER (ORDER BY node) - 1)::BIGINT AS node_id FROM (SELECT u AS node FROM links UNION SELECT v FROM links)"),
    "link_degree": net("SELECT u AS node_id, count(*) AS degree FROM links WHERE u <> v GROUP BY 1"),
    "graph_info": net("SELECT (SELECT count(*) FROM links) AS number_of_links, (SELECT count(*) FROM (SELECT u FROM links UNION SELECT v FROM links)) AS number_of_nodes"),
    "edge_list": net("SELECT link_id, u, v FROM links"),
    "demand_compile": net("SELECT trip_id, source, target, CASE WHEN volume > 2 THEN volume * 2 ELSE volume END AS volume FROM demand"),
    "demand_by_source": net("SELECT source, count(*) AS number_of_targets, sum(volume) AS volume FROM demand GROUP BY 1"),
    "demand_info": net("SELECT count(DISTINCT source) AS n_sources, count(*) AS n_trips FROM demand"),
    "total_demand": net("SELECT sum(volume) AS total_demand FROM demand WHERE volume > 0"),
    "od_matrix_sum": net(f", {CELLS} SELECT i + 1 AS from_zone, j + 1 AS to_zone, sum(value) AS volume FROM cells GROUP BY 1, 2 HAVING sum(value) <> 0"),
    "od_travel_demand": net(
        f""", {CELLS}, zones AS (SELECT zone::BIGINT AS zone, (zone // 2)::BIGINT AS node_id FROM range(1, 22) t(zone)),
        summed AS (SELECT i + 1 AS fz, j + 1 AS tz, sum(value) AS volume FROM cells GROUP BY 1, 2)
        SELECT (row_number() OVER (ORDER BY fz, tz) - 1)::BIGINT AS seq, a.node_id AS source, b.node_id AS target, volume
        FROM summed JOIN zones a ON a.zone = fz JOIN zones b ON b.zone = tz WHERE volume > 0 AND a.node_id <> b.node_id"""
    ),
    "cost_bpr": net(f"SELECT link_id, {BPR_COST.format(weight='0.15')} FROM flowing"),
    "cost_marginal_bpr": net(f"SELECT link_id, {BPR_COST.format(weight='(5 * 0.15)')} FROM flowing"),
    "cost_linear": net("SELECT link_id, round(free_flow_time / 100 * flow + capacity / 1000, 6) AS cost FROM flowing"),
    "cost_marginal_linear": net("SELECT link_id, round(2 * free_flow_time / 100 * flow + capacity / 1000, 6) AS cost FROM flowing"),
    "minimum_capacity": net("SELECT min(capacity) AS minimum_capacity, min(capacity) <= 0 AS bad FROM links"),
    "capacity_clip": net("SELECT link_id, greatest(100.0, least(9999.0, capacity))::DOUBLE AS capacity FROM links"),
    "virtual_links": net("SELECT link_id, greatest(100, least(9999, capacity)) >= 9999 AS is_virtual, link_id % 3 > 0 AS is_link FROM links"),
    "free_flow_time": net(
        """SELECT link_id, CASE WHEN n <= 0 THEN 0.0 ELSE round(capacity / n, 6) END::DOUBLE AS speed_by_length,
        CASE WHEN n <= 0 THEN 0.0 ELSE round(n / capacity, 6) END::DOUBLE AS length_by_speed FROM (SELECT *, free_flow_time * (link_id % 4) AS n FROM links)"""
    ),
    "bidirectional_expand": net(
        """SELECT link_id * 2 AS seq, link_id AS id, u, v, 30.0::DOUBLE AS speed, greatest(100.0, least(9999.0, capacity))::DOUBLE AS capacity, u AS zone, 1::BIGINT AS lanes,
          u || '-' || link_id || '-' || v AS geometry FROM links
        UNION ALL SELECT link_id * 2 + 1, link_id, v, u, 20.0, 100.0, v, link_id % 2, v || '-' || link_id || '-' || u FROM links"""
    ),
    "parallel_links": net(
        """, folded AS (SELECT (row_number() OVER (ORDER BY u, v) - 1)::BIGINT AS seq, u % 8 AS u, v % 8 AS v, orders FROM flows)
        SELECT u, v, min(seq) AS seq, arg_max(orders, seq) AS orders FROM folded GROUP BY 1, 2"""
    ),
    "zone_grouping": net(
        """SELECT u % 6 AS zone, string_agg(printf('%02d-%02d', u, v), ',' ORDER BY u, v) AS links
        FROM links WHERE greatest(100, least(9999, capacity)) >= 9999 OR link_id % 2 = 0 GROUP BY 1"""
    ),
    "shortest_distances": walks("SELECT source, node, round(dist, 6) AS dist FROM best"),
    "best_path_cost": walks("SELECT trip_id, round(cost, 6) AS cost, round(coalesce(cost, -1.0), 6)::DOUBLE AS strict_cost FROM found"),
    "unreachable_trips": walks("SELECT trip_id, source, target, volume FROM found WHERE path IS NULL"),
    "shortest_paths_edges": walks(f"SELECT trip_id, {TEXT} AS links FROM found WHERE path IS NOT NULL"),
    "shortest_paths_relaxed": walks(f"SELECT trip_id, {TEXT} AS links FROM found WHERE path IS NOT NULL"),
    "aon_flow": walks("SELECT link_id, flow::DOUBLE AS flow FROM loaded"),
    "aon_flow_relaxed": walks("SELECT link_id, flow::DOUBLE AS flow FROM loaded"),
    "path_dedupe": walks(f"SELECT CASE WHEN target % 2 = 1 THEN trip_id + 1000 ELSE trip_id END AS trip_id, {TEXT} AS links FROM found WHERE path IS NOT NULL"),
    "path_counts": walks("SELECT source, count(*) AS number_of_paths, sum(len(path))::BIGINT AS number_of_links FROM found WHERE path IS NOT NULL GROUP BY 1"),
    "path_keys": walks(
        """, keyed AS (SELECT trip_id, array_to_string(list_transform(list_reverse(path), lambda x: printf('%02X%02X0000', x % 256, x // 256)), '') AS key FROM found WHERE path IS NOT NULL)
        SELECT (row_number() OVER (ORDER BY key) - 1)::BIGINT AS counter, trip_id, key FROM keyed"""
    ),
    "total_travel_time": walks("SELECT round(sum(flow * cost), 2) AS tstt FROM costed"),
    "shortest_travel_time": walks("SELECT round(sum(volume * cost), 2) AS sptt FROM found"),
    "excess_cost": walks(
        """, again(source, node, dist, seen) AS (
          SELECT DISTINCT u, u, 0.0::DOUBLE, [u] FROM costed
          UNION ALL
          SELECT source, c.v, dist + c.cost, list_append(seen, c.v) FROM again JOIN costed c ON c.u = node WHERE NOT list_contains(seen, c.v) AND len(seen) < 9),
        least_cost AS (SELECT source, node, min(dist) AS dist FROM again GROUP BY ALL),
        reached AS (SELECT f.volume, l.dist FROM found f JOIN least_cost l ON l.source = f.source AND l.node = f.target WHERE path IS NOT NULL)
        SELECT round(((SELECT sum(flow * cost) FROM costed) - sum(volume * dist)) / sum(volume), 4) AS gap FROM reached"""
    ),
    "line_search_slopes": walks(
        """, moving AS (SELECT c.*, f.orders::DOUBLE AS own, c.flow - f.orders AS direction FROM costed c JOIN flows f USING (u, v))
        SELECT s / 8.0::DOUBLE AS step, round(sum(free_flow_time * (1 + 0.15 * power((own + s / 8.0::DOUBLE * direction) / capacity, 4)) * direction), 2) AS sigma
        FROM moving, range(9) t(s) GROUP BY s"""
    ),
    "vector_kernels": net(
        """SELECT link_id, round(flow + free_flow_time, 6) AS added, round(flow - free_flow_time, 6) AS subtracted, round(flow * free_flow_time, 6) AS multiplied,
        round(flow / free_flow_time, 6) AS divided, round(flow * 0.5, 6) AS scaled, round(flow + 1.5, 6) AS raised, round(power(free_flow_time, 1.5), 6) AS powered FROM flowing"""
    ),
    "vector_dot": net("SELECT round(sum(flow * free_flow_time), 4) AS dot, sum(flow) AS total FROM flowing"),
    "solution_error": net(
        """, priced AS (SELECT flow, free_flow_time * (1 + 0.15 * power(flow / capacity, 4)) AS cost FROM flowing)
        SELECT round(sqrt(sum(power((flow * 1.01 - flow) / flow, 2))), 6) AS relative_norm, round(sum(flow * 1.01 * cost) / sum(flow * cost) - 1, 6) AS cost_ratio_excess FROM priced"""
    ),
    "incidence_trip_path": walks('SELECT trip_id AS "row", path_id AS col, 1.0::DOUBLE AS value FROM numbered'),
    "incidence_link_path": walks('SELECT unnest(path) AS "row", path_id AS col, 1.0::DOUBLE AS value FROM numbered'),
    "incidence_shape": walks("SELECT max(l) + 1 AS n_rows, max(path_id) + 1 AS n_cols, count(*) AS nnz FROM (SELECT path_id, unnest(path) AS l FROM numbered)"),
    "lp_constraints": walks(
        """, reached AS (SELECT trip_id, volume FROM found WHERE path IS NOT NULL)
        SELECT trip_id AS cid, '=' AS sense, volume::DOUBLE AS rhs FROM reached
        UNION ALL SELECT link_id + (SELECT max(trip_id) + 1 FROM reached), '=', flow FROM loaded"""
    ),
    "lp_coefficients": walks(
        """, reached AS (SELECT max(trip_id) + 1 AS n FROM found WHERE path IS NOT NULL),
        coeffs AS (SELECT trip_id AS r FROM numbered UNION ALL SELECT unnest(path) + (SELECT n FROM reached) FROM numbered)
        SELECT r AS "row", count(*) AS n, count(*)::DOUBLE AS total FROM coeffs GROUP BY 1"""
    ),
    "strong_components": reach("SELECT node, component FROM named"),
    "scc_largest": reach("SELECT node, node_id FROM core"),
    "scc_links": reach("SELECT link_id, a.node_id AS u, b.node_id AS v FROM links JOIN core a ON a.node = u JOIN core b ON b.node = v"),
    "centroid_resolution": net(
        """, zl AS (SELECT u AS zone, u, v FROM links UNION ALL SELECT (u + 1) % 25, u, v FROM links WHERE u % 4 = 0),
        total AS (SELECT zone, count(DISTINCT u * 100 + v) AS n FROM zl GROUP BY 1),
        ends AS (SELECT DISTINCT zone, u * 100 + v AS l, unnest([u, v]) AS node_id FROM zl),
        held AS (SELECT zone, node_id, count(DISTINCT l) AS n FROM ends GROUP BY 1, 2),
        ranked AS (SELECT zone, node_id, row_number() OVER (PARTITION BY zone ORDER BY coalesce(d, 0), node_id) AS r
          FROM held JOIN total USING (zone, n) LEFT JOIN (SELECT u AS node_id, count(*) AS d FROM links GROUP BY 1) USING (node_id))
        SELECT total.zone, node_id FROM total LEFT JOIN ranked ON ranked.zone = total.zone AND r = 1"""
    ),
    "nearest_node": NEAREST,
}
