"""The sources, sinks and stores as queries: the derived network written in each format and read back.

The files are written in the scratch folder from the network of :mod:`testnet`, which has
a few hundred rows at any scale, and go when Python ends.
"""

from __future__ import annotations

import struct
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import Bpr, from_spec, marginal, per_link_bpr
from ..operators import demand as trips
from ..operators import graph, pathflow, pathstore
from ..operators.equilibrium import FrankWolfeSettings, Problem, solve
from ..operators.loading import load_network
from ..operators.paths import shortest_paths
from ..scratch import cut, folder
from ..sources import odmatrix, pathdump, shapefile, store, tntp
from . import testnet
from .oracles import BPR_COST, net, reach, walks
from .queries import BPR, link_features, r6

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Registers a query with the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _net_file(spark: SparkSession, sf: str) -> str:
    rows = testnet.links(spark, sf).orderBy(F.desc("link_id")).collect()
    head = f"<NUMBER OF ZONES> 25\n<NUMBER OF NODES> 25\n<FIRST THRU NODE> 1\n<NUMBER OF LINKS> {len(rows)}\n<END OF METADATA>\n\n\n~\tinit\tterm\tcapacity\t;\n"
    line = "\t{u}\t{v}\t{c!r}\t1\t{t!r}\t{b}\t4\t0\t0\t{k}\t;\n"
    return head + "".join(line.format(u=r["u"] + 1, v=r["v"] + 1, c=r["capacity"], t=r["free_flow_time"], b=0.15 + r["link_id"] / 100, k=r["link_id"] % 3) for r in rows)


def _trips_file(spark: SparkSession, sf: str) -> str:
    rows = testnet.demand(spark, sf).orderBy(F.desc("source"), "target").collect()
    out = ["<NUMBER OF ZONES> 25", f"<TOTAL OD FLOW> {sum(r['volume'] for r in rows)}", "<END OF METADATA>", ""]
    last = None
    for r in rows:
        if r["source"] != last:
            out.append(f"Origin  {r['source'] + 1}")
            last = r["source"]
        out.append(f"    {r['target'] + 1} :  {r['volume']};  {r['source'] + 1} : 0.0;")
    return "\n".join(out) + "\n"


def _flow_file(spark: SparkSession, sf: str) -> str:
    rows = testnet.links(spark, sf).orderBy(F.desc("link_id")).collect()
    return "From\tTo\tVolume\tCost\n" + "".join(f"{r['u'] + 1}\t{r['v'] + 1}\t{r['capacity']!r}\t{r['free_flow_time']!r}\n" for r in rows)


def _town(spark: SparkSession, sf: str) -> tntp.Directory:
    """A folder ``nations`` with the three files of a network."""
    path = folder(spark, "files") + "/nations"
    for kind, made in (("net", _net_file), ("trips", _trips_file), ("flow", _flow_file)):
        store.write_text(spark, f"{path}/nations_{kind}.tntp", made(spark, sf))
    return tntp.Directory(path)


@query(net("SELECT 25 AS n_zones, 25 AS n_nodes, count(*)::INT AS n_links, 1 AS first_node FROM links"))
def file_network_metadata(spark, sf):
    return tntp.network_metadata(tntp.lines(spark, _town(spark, sf).path_of("net"))).drop("file")


@query(net("SELECT 25 AS n_zones, sum(volume) AS total_flow FROM demand"))
def file_trips_metadata(spark, sf):
    return tntp.trips_metadata(tntp.lines(spark, _town(spark, sf).path_of("trips"))).drop("file")


@query(
    net(
        """SELECT link_id, (u + 1)::INT AS from_node, (v + 1)::INT AS to_node, capacity, 1.0::DOUBLE AS length, free_flow_time, round(0.15 + link_id / 100, 6)::DOUBLE AS b,
        4.0::DOUBLE AS power, 0.0::DOUBLE AS speed_limit, 0.0::DOUBLE AS toll, (link_id % 3)::INT AS link_type FROM links"""
    )
)
def file_network(spark, sf):
    return _town(spark, sf).network(spark).withColumn("b", F.round("b", 6))


@query(
    net("SELECT unnest(['NUMBER OF ZONES', 'NUMBER OF NODES', 'FIRST THRU NODE', 'NUMBER OF LINKS']) AS key, unnest(['25', '25', '1', count(*)::VARCHAR]) AS value FROM links")
)
def file_metadata_entries(spark, sf):
    return tntp.metadata(tntp.lines(spark, _town(spark, sf).path_of("net"))).select("key", "value")


@query(net("SELECT (SELECT count(*) FROM links) AS data, 5::BIGINT AS metadata, 1::BIGINT AS ends, 1::BIGINT AS comments, 2::BIGINT AS empty, 0::BIGINT AS numeric"))
def file_line_kinds(spark, sf):
    """How many lines of a network file are of each kind."""
    line = F.col("line")
    kinds = {"data": ~tntp.is_header(line), "metadata": tntp.is_metadata(line), "ends": tntp.is_end_of_metadata(line), "comments": tntp.is_comment(line), "empty": tntp.is_empty(line), "numeric": tntp.is_numeric(line)}
    return tntp.lines(spark, _town(spark, sf).path_of("net")).agg(*(F.sum(c.cast("long")).alias(k) for k, c in kinds.items()))


@query(net("SELECT (row_number() OVER (ORDER BY source, target) - 1)::BIGINT AS seq, (source + 1)::INT AS origin, (target + 1)::INT AS destination, volume FROM demand"))
def file_trips(spark, sf):
    return _town(spark, sf).trips(spark)


@query(
    net(
        """, ends AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::BIGINT AS node_id FROM (SELECT source AS node FROM demand UNION SELECT target FROM demand))
        SELECT trip_id, a.node_id AS source, b.node_id AS target, volume FROM demand JOIN ends a ON a.node = source JOIN ends b ON b.node = target"""
    )
)
def file_trips_encoded(spark, sf):
    """Trips of a file by a node index, compiled."""
    found = cut(_town(spark, sf).trips(spark))
    return trips.compile_demand(trips.encode_trips(found, graph.node_index(found, "origin", "destination")))


@query(net("SELECT link_id, (u + 1)::INT AS origin, (v + 1)::INT AS destination, capacity AS volume, free_flow_time AS cost FROM links"))
def file_solution(spark, sf):
    return _town(spark, sf).solution(spark)


@query(net("SELECT link_id, capacity AS flow, free_flow_time AS cost FROM links"))
def file_solution_columns(spark, sf):
    found = cut(_town(spark, sf).solution(spark))
    return tntp.solution_flow(found).join(tntp.solution_cost(found), "link_id")


@query(net("SELECT 'nations' AS name, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM demand) AS trips, (SELECT count(*) FROM links) AS solved"))
def file_directory(spark, sf):
    town = _town(spark, sf)
    counts = {"links": town.network(spark), "trips": town.trips(spark), "solved": town.solution(spark)}
    return spark.range(1).select(F.lit(town.name()).alias("name"), *(F.lit(df.count()).cast("long").alias(k) for k, df in counts.items()))


def _file_costs(spark, sf, price) -> DataFrame:
    links = cut(_town(spark, sf).network(spark))
    flowing = testnet.flows(spark, sf).select((F.col("u") + 1).alias("from_node"), (F.col("v") + 1).alias("to_node"), F.col("orders").cast("double").alias("flow"))
    return links.join(flowing, ["from_node", "to_node"]).select("link_id", r6(price(links), "cost"))


@query(net(f"SELECT link_id, {BPR_COST.format(weight='0.15')} FROM flowing"))
def file_cost(spark, sf):
    """Costs by the parameters of the first link."""
    return _file_costs(spark, sf, lambda links: tntp.first_link_bpr(links).cost(F.col("flow")))


@query(net(f"SELECT link_id, {BPR_COST.format(weight='(5 * 0.15)')} FROM flowing"))
def file_marginal_cost(spark, sf):
    return _file_costs(spark, sf, lambda links: marginal(tntp.first_link_bpr(links)).cost(F.col("flow")))


@query(net(f"SELECT link_id, {BPR_COST.format(weight='round(0.15 + link_id / 100, 6)')} FROM flowing"))
def file_cost_by_link(spark, sf):
    return _file_costs(spark, sf, lambda links: per_link_bpr(F.col("flow")))


@query(net(f"SELECT link_id, {BPR_COST.format(weight='0.15')} FROM flowing"))
def cost_registry(spark, sf):
    """The function of a saved description."""
    flowing = testnet.flows(spark, sf).select("u", "v", F.col("orders").cast("double").alias("flow"))
    return from_spec({"name": "BPR", "kwargs": asdict(BPR)}).with_cost(testnet.links(spark, sf).join(flowing, ["u", "v"])).select("link_id", r6(F.col("cost"), "cost"))


def dbf(fields: list[tuple[str, int]], rows: list[tuple], deleted: frozenset[int] = frozenset()) -> bytes:
    """A table of numbers in the dBase format; records in ``deleted`` are marked so."""
    head, size = 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields)
    out = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), head, size)
    out += b"".join(struct.pack("<11sc4xBB14x", name.encode(), b"N", width, 6) for name, width in fields) + b"\r"
    for i, row in enumerate(rows):
        out += (b"*" if i in deleted else b" ") + b"".join(("" if v is None else str(v)).rjust(w)[:w].encode() for (_, w), v in zip(fields, row))
    return out + b"\x1a"


def shp(shapes: list[list[tuple[float, float]]]) -> bytes:
    """Points (one each) or lines of one part in the shape format."""
    kind = 1 if all(len(s) == 1 for s in shapes) else 3
    out = b""
    for i, points in enumerate(shapes):
        flat = [c for p in points for c in p]
        body = struct.pack("<i2d", 1, *flat) if kind == 1 else struct.pack(f"<i4d3i{len(flat)}d", 3, 0, 0, 0, 0, 1, len(points), 0, *flat)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return struct.pack(">7i2i8d", 9994, 0, 0, 0, 0, 0, 50 + len(out) // 2, 1000, kind, *[0.0] * 8) + out


def shx(data: bytes) -> bytes:
    """The index of the shapes in ``data``, the bytes of a .shp file."""
    out, at = b"", 100
    while at < len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        out += struct.pack(">2i", at // 2, words)
        at += 8 + 2 * words
    return data[:24] + struct.pack(">i", 50 + len(out) // 2) + data[28:100] + out


def _shapefile(spark: SparkSession, stem: str, table: bytes, shapes: bytes) -> None:
    for extension, data in ((".dbf", table), (".shp", shapes), (".shx", shx(shapes))):
        store.write_bytes(spark, stem + extension, data)


LINK_FIELDS = ["ID_1", "LENGTH", "AB_SPEED", "BA_SPEED", "AB_CAPACIT", "BA_CAPACIT", "AB_ZONE", "BA_ZONE", "AB_LANES", "BA_LANES", "LAT1", "LON1", "LAT2", "LON2"]


def _shapes(spark: SparkSession, sf: str) -> str:
    """A folder of shapefiles: nations at (id, id % 5), the links as roads, a deleted record in each file."""
    path = folder(spark, "files") + "/nations"
    nations = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()
    nodes = [(i + 100, float(i), float(i % 5)) for (i,) in nations]
    nodes.insert(3, (999, 50.0, 50.0))
    _shapefile(spark, f"{path}/node", dbf([("ID", 8), ("LAT", 16), ("LON", 16)], nodes, frozenset([3])), shp([[(y, x)] for _, x, y in nodes]))
    rows = []
    for r in testnet.links(spark, sf).orderBy("link_id").collect():
        u, v, k = r["u"], r["v"], r["link_id"]
        capacity = 99999 if v == (u + 1) % 25 else 500
        rows.append((k, r["free_flow_time"], 30, 20, capacity, 500, u, 0, 1, 0, float(u), float(u % 5), float(v), float(v % 5)))
    rows.insert(1, (rows[0][0] + 5000, *rows[0][1:]))
    _shapefile(spark, f"{path}/link", dbf([(f, 20) for f in LINK_FIELDS], rows, frozenset([1])), shp([[(r[11], r[10]), (float(r[0] % 5000), 0.5), (r[13], r[12])] for r in rows]))
    for name, least in (("a", 0), ("b", 1)):
        store.write_text(spark, f"{path}/ODmatrix/{name}.csv", _matrix(spark, sf, least))
    return path


def _matrix(spark: SparkSession, sf: str, least: int) -> str:
    cells = [["0"] * 25 for _ in range(25)]
    for r in testnet.demand(spark, sf).where(F.col("volume") > least).collect():
        cells[r["source"]][r["target"]] = repr(r["volume"])
    cells[0][0] = "x" if least else "0"
    return "\n".join(",".join(row) for row in cells) + "\n"


@query(
    "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS node_id, n_nationkey::BIGINT + 100 AS name, n_nationkey::DOUBLE AS x, (n_nationkey % 5)::DOUBLE AS y FROM nation"
)
def shape_nodes(spark, sf):
    return shapefile.nodes_of(shapefile.features(spark, f"{_shapes(spark, sf)}/node.shp"))


@query(net("SELECT link_id AS record, link_id AS id, 3 AS points, 14 AS properties, v % 5 + 0.0::DOUBLE AS last_x FROM links"))
def shape_features(spark, sf):
    found = shapefile.features(spark, f"{_shapes(spark, sf)}/link.shp", per_part=16)
    return found.select("record", shapefile.prop("ID_1", "long").alias("id"), F.size("geometry").alias("points"), F.size("properties").alias("properties"), F.element_at("geometry", 3).x.alias("last_x"))


WAYS = "greatest(100, CASE WHEN v = (u + 1) % 25 THEN 9999 ELSE 500 END)"


@query(
    net(
        f"""SELECT link_id * 2 AS seq, link_id AS id, {WAYS} AS capacity, u AS zone, true AS is_link, {WAYS} >= 9999 AS is_virtual,
          CASE WHEN free_flow_time <= 0 THEN 0.0 ELSE round(30 / free_flow_time, 6) END::DOUBLE AS free_flow_time FROM links
        UNION ALL SELECT link_id * 2 + 1, link_id, 500, 0, false, false, CASE WHEN free_flow_time <= 0 THEN 0.0 ELSE round(20 / free_flow_time, 6) END::DOUBLE FROM links"""
    )
)
def shape_links(spark, sf):
    """The roads in both directions, with what is derived from their attributes."""
    found = shapefile.extended(shapefile.directed_links(shapefile.features(spark, f"{_shapes(spark, sf)}/link.shp")))
    return found.select("seq", "id", F.col("capacity").cast("int").alias("capacity"), "zone", "is_link", "is_virtual", r6(F.col("free_flow_time"), "free_flow_time"))


@query(reach("SELECT (row_number() OVER (ORDER BY link_id) - 1)::BIGINT AS link_id, link_id AS id, a.node_id AS u, b.node_id AS v FROM links JOIN core a ON a.node = u JOIN core b ON b.node = v"))
def shape_network(spark, sf):
    """The largest strongly connected part of the roads."""
    _, links, _ = shapefile.read_network(spark, _shapes(spark, sf))
    return links.select("link_id", "id", "u", "v")


@query(reach("SELECT node_id, node + 100 AS name, node::DOUBLE AS x, (node % 5)::DOUBLE AS y FROM core"))
def shape_network_nodes(spark, sf):
    nodes, _, _ = shapefile.read_network(spark, _shapes(spark, sf))
    return nodes


@query(
    reach(
        f"""SELECT (row_number() OVER (ORDER BY link_id) - 1)::BIGINT AS link_id, round(CASE WHEN free_flow_time <= 0 THEN 0.0 ELSE 30 / free_flow_time END * (1 + 0.15 * power(300.0 / {WAYS}, 4)), 6) AS cost
        FROM links JOIN core a ON a.node = u JOIN core b ON b.node = v"""
    )
)
def shape_cost(spark, sf):
    """The costs of a problem of shapefiles at a flow of 300 everywhere."""
    p = odmatrix.problem_from_shapefiles(spark, _shapes(spark, sf))
    return p.links.select("link_id", r6(p.cost.cost(F.lit(300.0)), "cost"))


CSV = """, cells AS (
  SELECT 'a.csv' AS name, i, j, coalesce(volume, 0.0) AS value FROM range(25) a(i), range(25) b(j) LEFT JOIN demand ON source = i AND target = j
  UNION ALL SELECT 'b.csv', i, j, CASE WHEN i = 0 AND j = 0 THEN NULL WHEN volume > 1 THEN volume ELSE 0.0 END FROM range(25) a(i), range(25) b(j) LEFT JOIN demand ON source = i AND target = j)"""


@query(net(f"{CSV} SELECT name, i, j, value FROM cells"))
def matrix_cells(spark, sf):
    """All cells of a folder's matrices; null stands for what isn't a number."""
    found = odmatrix.read_directory(spark, f"{_shapes(spark, sf)}/ODmatrix")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("name"), "i", "j", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(net(f"{CSV} SELECT i + 1 AS from_zone, j + 1 AS to_zone, sum(value) AS volume FROM cells WHERE i > 0 OR j > 0 GROUP BY 1, 2 HAVING sum(value) <> 0"))
def matrix_files_sum(spark, sf):
    return trips.matrix_demand(odmatrix.read_directory(spark, f"{_shapes(spark, sf)}/ODmatrix").where("not isnan(value)"))


def _paths(spark, sf) -> DataFrame:
    """(trip_id, links) of the best paths at free flow."""
    links = cut(testnet.links(spark, sf).withColumn("cost", F.col("free_flow_time")))
    found = shortest_paths(links, cut(testnet.demand(spark, sf)))
    return cut(found.where("links is not null").select("trip_id", "links"))


def _text(c: str = "links"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-").alias("links")


PATHS = "SELECT trip_id, array_to_string(path, '-') AS links FROM found WHERE path IS NOT NULL"


def _dumps(spark, sf) -> list[str]:
    """The paths in two folders of dumps, by the last bit of their trips."""
    path, found = folder(spark, "files"), _paths(spark, sf)
    out = [f"{path}/paths{k}" for k in (0, 1)]
    for k in (0, 1):
        pathdump.write_paths(found.where(F.col("trip_id") % 2 == k), out[k])
    return out


@query(walks(f"{PATHS} AND trip_id % 2 = 0"))
def path_dump(spark, sf):
    return pathdump.read_paths(spark, _dumps(spark, sf)[0]).select("trip_id", _text())


@query(walks(PATHS))
def path_dumps(spark, sf):
    return pathdump.read_paths(spark, *_dumps(spark, sf), number_of_links=75, number_of_trips=600).select("trip_id", _text())


def _kv(spark, sf) -> pathstore.PathStore:
    """A store of the paths, then those of odd targets again for another trip."""
    kv = pathstore.PathStore(spark, folder(spark, "store"))
    found = _paths(spark, sf)
    pathdump.load_into(kv, found)
    odd = testnet.demand(spark, sf).where("target % 2 = 1").select("trip_id")
    kv.add_paths(found.join(odd, "trip_id", "left_semi").withColumn("trip_id", F.col("trip_id") + 1000))
    return kv


STORED = "SELECT CASE WHEN target % 2 = 1 THEN trip_id + 1000 ELSE trip_id END AS trip_id, array_to_string(path, '-') AS links FROM found WHERE path IS NOT NULL"
KEYED = """, keyed AS (
  SELECT CASE WHEN target % 2 = 1 THEN trip_id + 1000 ELSE trip_id END AS trip_id,
    array_to_string(list_transform(list_reverse(path), lambda x: printf('%02X%02X0000', x % 256, x // 256)), '') AS key
  FROM found WHERE path IS NOT NULL)"""


@query(walks(STORED))
def store_paths(spark, sf):
    """What a store holds after upserts, decoded."""
    return _kv(spark, sf).paths().select("trip_id", _text())


@query(walks(f"{KEYED} SELECT (row_number() OVER (ORDER BY key) - 1)::BIGINT AS counter, key, printf('%02X%02X000000000000', trip_id % 256, trip_id // 256) AS value FROM keyed"))
def store_scan(spark, sf):
    """The keys and values in the order of the keys' bytes."""
    return _kv(spark, sf).scan().select("counter", F.hex("key").alias("key"), F.hex("value").alias("value"))


@query(walks(f"{KEYED} SELECT (row_number() OVER (ORDER BY key) - 1)::BIGINT AS counter, key, trip_id FROM keyed QUALIFY row_number() OVER (ORDER BY key) <= 5"))
def store_cursor(spark, sf):
    """The first five rows that a cursor stands on."""
    cursor, rows = _kv(spark, sf).cursor(), []
    cursor.reset()
    while cursor.is_valid() and cursor.counter < 5:
        rows.append((cursor.counter, cursor.key().hex().upper(), pathstore.decode_value(cursor.value())))
        cursor.next()
    return spark.createDataFrame(rows, "counter long, key string, trip_id long")


@query(walks(f"{KEYED} SELECT trip_id, key FROM keyed WHERE key = (SELECT min(key) FROM keyed) UNION ALL SELECT NULL, 'ABCD'"))
def store_look_up(spark, sf):
    """The value of the least key and of one that the store lacks."""
    kv = _kv(spark, sf)
    key = kv.frame().agg(F.min(F.hex("key"))).first()[0]
    got = [(kv.get(bytes.fromhex(k)), k) for k in (key, "ABCD")]
    return spark.createDataFrame([(None if v is None else pathstore.decode_value(v), k) for v, k in got], "trip_id long, key string")


@query(walks("SELECT source, target, array_to_string(path, '-') AS links FROM found WHERE path IS NOT NULL"))
def legacy_path_set(spark, sf):
    """Paths by source and target in nested listings of block style."""
    path = folder(spark, "files") + "/listing"
    ends = testnet.demand(spark, sf).select("trip_id", "source", "target")
    pathdump.listing_lines(_paths(spark, sf).join(ends, "trip_id")).write.text(path)
    return pathdump.read_listing(spark, path).select("source", "target", _text())


@query(net("SELECT link_id, u, v, 25::BIGINT AS number_of_nodes, 'nations' AS name FROM links"))
def saved_graph(spark, sf):
    path = folder(spark, "files")
    store.save_graph(graph.DiGraph(testnet.links(spark, sf), 25, "nations"), path)
    held = store.load_graph(spark, path)
    return held.links_frame.withColumns({"number_of_nodes": F.lit(held.number_of_nodes).cast("long"), "name": F.lit(held.name)})


@query(net("SELECT link_id, u, v FROM links"))
def saved_graph_beside(spark, sf):
    """A graph of more links than stand in its JSON file."""
    path = folder(spark, "files")
    store.save_graph(graph.DiGraph(testnet.links(spark, sf), 25, "nations"), path, max_rows=10)
    return store.load_graph(spark, path).links_frame


@query(net("SELECT trip_id, source, target, volume FROM demand"))
def saved_demand(spark, sf):
    path = folder(spark, "files")
    store.save_demand(testnet.demand(spark, sf), path)
    return store.load_demand(spark, path)


@query(net(f"SELECT link_id, {BPR_COST.format(weight='0.15')} FROM flowing"))
def saved_cost(spark, sf):
    path = folder(spark, "files")
    flowing = testnet.flows(spark, sf).select("u", "v", F.col("orders").cast("double").alias("flow"))
    links = cut(testnet.links(spark, sf).join(flowing, ["u", "v"]))
    store.save_cost(BPR, links, path)
    cost, columns = store.load_cost(spark, path)
    return columns.join(links.select("link_id", "flow"), "link_id").select("link_id", r6(cost.cost(F.col("flow")), "cost"))


@query("SELECT count(*) AS max_iterations, count(*)::DOUBLE / 1024 AS gap_tolerance, count(*)::DOUBLE / 1048576 AS line_search_tolerance FROM supplier")
def saved_settings(spark, sf):
    """As many steps as there are suppliers."""
    path = folder(spark, "files") + "/settings"
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    store.save_settings(spark, FrankWolfeSettings(n, n / 1024, n / 1048576), path)
    return spark.createDataFrame([asdict(store.load_settings(spark, path))], "max_iterations long, gap_tolerance double, line_search_tolerance double")


def _problem(spark, sf) -> Problem:
    """The derived network with the trips that have a path."""
    links = cut(testnet.links(spark, sf))
    demand = cut(testnet.demand(spark, sf))
    found = shortest_paths(links.withColumn("cost", F.col("free_flow_time")), demand).where("links is not null").select("trip_id")
    reached = graph.dense_ids(demand.join(found, "trip_id", "left_semi").withColumnRenamed("trip_id", "_old"), "trip_id", "_old")
    return Problem(links, cut(reached.select("trip_id", "source", "target", "volume")), BPR, "nations", 25)


@query(walks("SELECT 'nations' AS name, 25::BIGINT AS nodes, 'bpr' AS cost, (SELECT count(*) FROM links) AS links, count(*) AS trips, sum(volume) AS volume FROM found WHERE path IS NOT NULL"))
def saved_problem(spark, sf):
    path = folder(spark, "files")
    store.save_problem(_problem(spark, sf), path)
    p = store.load_problem(spark, path)
    return p.demand.agg(F.lit(p.name).alias("name"), F.lit(p.number_of_nodes).cast("long").alias("nodes"), F.lit(p.cost.name).alias("cost"), F.lit(p.links.count()).cast("long").alias("links"), F.count("*").alias("trips"), F.sum("volume").alias("volume"))


@query(walks("SELECT link_id, flow::DOUBLE AS flow, round(cost, 6) AS cost, 0::BIGINT AS iterations, true AS stamped FROM costed"))
def saved_result(spark, sf):
    """The loading at free flow, saved under the time of day and loaded."""
    result = solve(_problem(spark, sf), FrankWolfeSettings(0, 1e-4, 1e-6), keep_paths=True)
    path = store.save_result(result, folder(spark, "files"))
    back = store.load_result(spark, path)
    stamped = path.rsplit("/", 1)[-1].startswith("results-20") and back.duration >= 0
    return back.flow.select("link_id", "flow", r6(F.col("cost"), "cost"), F.lit(back.iterations).cast("long").alias("iterations"), F.lit(stamped).alias("stamped"))


@query(walks("SELECT trip_id, array_to_string(path, '-') AS links, round(cost, 6) AS cost FROM found"))
def loaded_network(spark, sf):
    """The public loading: paths and best costs at no flow."""
    _, paths, best = load_network(cut(testnet.links(spark, sf)), BPR, cut(testnet.demand(spark, sf)))
    return paths.join(best, "trip_id").select("trip_id", _text(), r6(F.col("cost"), "cost"))


@query(net("SELECT trip_id, s::BIGINT AS source, t::BIGINT AS target FROM (VALUES (1, 2), (3, 9), (4, 4)) AS asked(s, t) LEFT JOIN demand ON source = s AND target = t"))
def trip_look_up(spark, sf):
    demand = cut(testnet.demand(spark, sf))
    return spark.createDataFrame([(trips.index_of(demand, s, t), s, t) for s, t in ((1, 2), (3, 9), (4, 4))], "trip_id long, source long, target long")


def _entries(spark, sf) -> DataFrame:
    return pathflow.link_path(pathflow.number_paths(_paths(spark, sf)))


ENTRIES = "SELECT unnest(path) AS \"row\", path_id AS col, 1.0::DOUBLE AS value FROM numbered"


@query(walks(ENTRIES))
def saved_sparse(spark, sf):
    path = folder(spark, "files")
    store.save_sparse(_entries(spark, sf), f"{path}/matrix")
    return store.load_sparse(spark, f"{path}/matrix")


def _npz(by: str, kind: str):
    def run(spark, sf):
        path = f"{folder(spark, 'files')}/matrix.npz"
        store.save_npz(_entries(spark, sf), path, by)
        found, tag = store.load_npz(spark, path)
        return found.withColumn("kind", F.lit(tag))

    QUERIES[f"saved_npz_{kind}"] = run
    ORACLES[f"saved_npz_{kind}"] = walks(f"SELECT *, '{kind}' AS kind FROM ({ENTRIES})")


_npz("col", "csc")
_npz("row", "csr")


@query(
    walks(
        """, reached AS (SELECT max(trip_id) + 1 AS n FROM found WHERE path IS NOT NULL),
        coeffs AS (SELECT trip_id AS r, path_id FROM numbered UNION ALL SELECT unnest(path) + (SELECT n FROM reached), path_id FROM numbered),
        terms AS (SELECT r, string_agg('x' || path_id, ' + ' ORDER BY 'x' || path_id) AS t FROM coeffs GROUP BY 1),
        sides AS (SELECT trip_id AS r, volume::DOUBLE AS b FROM found WHERE path IS NOT NULL UNION ALL SELECT link_id + (SELECT n FROM reached), flow FROM loaded)
        SELECT ' c' || r || ': ' || coalesce(t, '0 x0') || ' = ' || b AS line FROM sides LEFT JOIN terms USING (r)
        UNION ALL SELECT unnest(['Minimize', ' obj: 0 x0', 'Subject To', 'End'])"""
    )
)
def lp_file(spark, sf):
    """The lines of the path program's text."""
    path = folder(spark, "files") + "/program"
    _program(spark, sf)[0].write(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _program(spark, sf) -> tuple[pathflow.LinearProgram, DataFrame]:
    links = cut(testnet.links(spark, sf).withColumn("cost", F.col("free_flow_time")))
    flow, _, _ = load_network(links.drop("cost"), BPR, cut(testnet.demand(spark, sf)))
    demand = testnet.demand(spark, sf)
    numbered = cut(pathflow.number_paths(_paths(spark, sf)))
    reached = demand.join(numbered.select("trip_id").distinct(), "trip_id", "left_semi")
    return pathflow.path_program(numbered, cut(reached), cut(flow)), numbered


@query(walks("SELECT path_id AS col, volume::DOUBLE AS flow FROM numbered JOIN found USING (trip_id)"))
def lp_values(spark, sf):
    """A feasible point of the path program: with one path for each trip there is no other."""
    program, _ = _program(spark, sf)
    values = program.optimize()
    listed = program.get_values(values)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(listed)], "col long, flow double")


@query(walks("SELECT (SELECT count(*) FROM found WHERE path IS NOT NULL) + (SELECT count(*) FROM links) AS n_constraints, (SELECT count(*) FROM numbered) AS n_variables"))
def lp_size(spark, sf):
    program, _ = _program(spark, sf)
    return spark.range(1).select(F.lit(program.n_constraints()).cast("long").alias("n_constraints"), F.lit(program.n_variables()).cast("long").alias("n_variables"))
