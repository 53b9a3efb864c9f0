import gzip
import io
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.functions import vectors
from flowloom.functions.cost import Bpr, Linear
from flowloom.operators import pathflow, pathstore
from flowloom.operators.equilibrium import FrankWolfeSettings, solve
from flowloom.operators.graph import DiGraph
from flowloom.plans import files
from flowloom.sources import odmatrix, pathdump, shapefile, store, tntp

from .networks import braess, by_link

NET = """<NUMBER OF ZONES> 2
<NUMBER OF NODES> 3
<FIRST THRU NODE>1
<NUMBER OF LINKS> 3
<END OF METADATA>


~\tinit\tterm\tcapacity\tlength\tfree\tb\tpower\tspeed\ttoll\ttype\t;
\t3\t1\t5.5\t1\t2\t0.2\t3\t0\t0\t1\t;
\t1\t3\t100\t1\t6\t0.15\t4\t0\t0\t1\t;

\t1\t2\t50\t2\t7\t0.3\t5\t0\t0\t1\t;
"""
TRIPS = """<NUMBER OF ZONES> 2
<TOTAL OD FLOW> 106.5
<END OF METADATA>

Origin  2
    1 :  100.0;    2 :    0.0;
Origin  1
    3 :    5.5;    1 :    1.0;
    2 :    0.0;
"""
FLOW = "From\tTo\tVolume\tCost\n2\t1\t4.5\t2\n1\t3\t6.0\t7.5\n"


def test_network_file(spark, tmp_path):
    rows = tntp.lines_of(spark, NET)
    meta = tntp.network_metadata(rows).first()
    assert (meta["n_zones"], meta["n_nodes"], meta["n_links"], meta["first_node"]) == (2, 3, 3, None)
    with pytest.warns(UserWarning):
        assert tntp.metadata_dict(NET)["NUMBER OF NODES"] == "3"
    folder = tmp_path / "town"
    folder.mkdir()
    (folder / "town_net.tntp").write_text(NET)
    (folder / "town_trips.tntp").write_text(TRIPS)
    (folder / "town_flow.tntp").write_text(FLOW)
    directory = tntp.Directory(str(folder))
    links = directory.network(spark)
    found = [(r["link_id"], r["from_node"], r["to_node"], r["capacity"]) for r in links.orderBy("link_id").collect()]
    assert found == [(0, 1, 2, 50.0), (1, 1, 3, 100.0), (2, 3, 1, 5.5)]
    assert tntp.first_link_bpr(links) == Bpr(0.3, 5.0)
    trips = [(r["origin"], r["destination"], r["volume"]) for r in directory.trips(spark).orderBy("seq").collect()]
    assert trips == [(1, 1, 1.0), (1, 3, 5.5), (2, 1, 100.0)]
    assert tntp.trips_metadata(tntp.lines_of(spark, TRIPS)).first()["total_flow"] == 106.5
    solution = directory.solution(spark)
    assert by_link(tntp.solution_flow(solution), "flow") == [6.0, 4.5]
    assert by_link(tntp.solution_cost(solution), "cost") == [7.5, 2.0]
    with pytest.raises(ValueError):
        directory.path_of("map")


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 48 bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k in sizes:
        spark.conf.unset(k)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_of_many_splits(spark, tmp_path, small_splits, end):
    """Origins whose blocks, headers and matrices run over many splits, in two files at once."""
    trips = {k: [(o, d, float(o * d + k)) for o in (7, 3, 5) for d in range(1, 41)] for k in (0, 1)}
    folder = tmp_path / "split"
    (folder / "csv").mkdir(parents=True)
    for k, rows in trips.items():
        out = [f"<NUMBER OF ZONES> {40 + k}", *(f"<KEY {i}> {i}" for i in range(9)), "<END OF METADATA>", ""]
        for o in (7, 3, 5):
            out += [f"Origin {o}", *(f" {d} : {v};" for a, d, v in rows if a == o)]
        (folder / f"t{k}_trips.tntp").write_bytes((end.join(out) + end).encode())
        (folder / "csv" / f"{k}.csv").write_bytes((end.join(f"{i},{i + k}" if i % 5 else "" for i in range(60)) + end).encode())
    rows = tntp.lines(spark, str(folder / "*.tntp"))
    assert rows.rdd.getNumPartitions() > 8 and rows.select("pos.block").distinct().count() > 8
    assert sorted((r["n_zones"], r["total_flow"]) for r in tntp.trips_metadata(rows).collect()) == [(40, None), (41, None)]
    assert tntp.metadata(rows).count() == 20
    found = tntp.read_trips(rows).orderBy("seq").collect()
    expected = [t for k in (0, 1) for t in sorted(x for x in trips[k] if x[2] > 0)]
    assert [(r["origin"], r["destination"], r["volume"]) for r in found] == expected
    cells = odmatrix.read_directory(spark, str(folder / "csv"))
    assert {(r["file"][-5:], r["i"], r["j"], r["value"]) for r in cells.collect()} == {(f"{k}.csv", i, j, float(i + k * j)) for k in (0, 1) for i in range(60) if i % 5 for j in (0, 1)}


def test_lines_are_read_without_bringing_a_file_together(spark, tmp_path):
    (tmp_path / "a.tntp").write_text(TRIPS)
    rows = tntp.lines(spark, str(tmp_path / "a.tntp"))
    plan = tntp.body(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    (tmp_path / "b.tntp").write_text("")
    assert tntp.lines(spark, str(tmp_path / "b.tntp")).count() == 0


def test_bad_values_raise(spark):
    with pytest.raises(Exception):
        tntp.read_network(tntp.lines_of(spark, NET.replace("5.5", "five"))).collect()
    with pytest.raises(Exception):
        tntp.read_trips(tntp.lines_of(spark, TRIPS.replace("5.5", "x"))).collect()


def test_header_predicates(spark):
    frame = spark.createDataFrame([("<A> 1",), ("<END OF METADATA>",), ("~ c",), (" \t",), ("1\t2",)], "line string")
    line = F.col("line")
    found = frame.select(*(f(line).alias(f.__name__) for f in (tntp.is_metadata, tntp.is_end_of_metadata, tntp.is_comment, tntp.is_empty, tntp.is_header))).collect()
    assert [tuple(r) for r in found] == [(True, False, False, False, True), (True, True, False, False, True), (False, False, True, False, True), (False, False, False, True, True), (False,) * 5]


def write_dbf(path, fields, rows):
    size = 1 + sum(w for _, w in fields)
    head = 32 + 32 * len(fields) + 1
    out = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), head, size)
    for name, width in fields:
        out += struct.pack("<11sc4xBB14x", name.encode(), b"N", width, 6)
    out += b"\r"
    for row in rows:
        out += b" " + b"".join(("" if v is None else str(v)).rjust(w).encode() for (_, w), v in zip(fields, row))
    path.write_bytes(out + b"\x1a")


def write_shp(path, shapes, kind):
    out = b""
    for i, points in enumerate(shapes):
        flat = [c for p in points for c in p]
        body = struct.pack("<i2d", 1, *flat) if kind == 1 else struct.pack(f"<i4d3i{len(flat)}d", 3, 0, 0, 0, 0, 1, len(points), 0, *flat)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    path.write_bytes(struct.pack(">7i2i8d", 9994, 0, 0, 0, 0, 0, 50 + len(out) // 2, 1000, kind, *[0.0] * 8) + out)


@pytest.fixture
def town(tmp_path):
    """Four nodes in a circle with two zones; a fifth node hangs off it one way."""
    folder = tmp_path / "circle"
    (folder / "ODmatrix").mkdir(parents=True)
    nodes = [(11, 0.0, 0.0), (12, 0.0, 1.0), (13, 1.0, 1.0), (14, 1.0, 0.0), (15, 5.0, 5.0)]
    write_dbf(folder / "node.dbf", [("ID", 6), ("LAT", 12), ("LON", 12)], nodes)
    write_shp(folder / "node.shp", [[(y, x)] for _, x, y in nodes], 1)
    fields = ["ID_1", "LENGTH", "AB_SPEED", "BA_SPEED", "AB_CAPACIT", "BA_CAPACIT", "AB_ZONE", "BA_ZONE", "AB_LANES", "BA_LANES", "LAT1", "LON1", "LAT2", "LON2"]
    at = {n: (x, y) for n, x, y in nodes}
    links = [(1, 2.0, 30, 20, 50, 99999, 0, 1, 1, 1, 11, 12), (2, 1.0, 30, 30, 500, 500, 0, 0, 1, 1, 12, 13), (3, 0.0, 30, 30, 99999, 500, 2, 0, 1, 1, 13, 14), (4, 4.0, 40, 30, 500, 500, 0, 0, 1, 0, 13, 15), (5, 1.0, 10, 10, 700, 700, 0, 0, 1, 1, 14, 11)]
    rows = [(*r[:10], at[r[10]][0] + 0.001, at[r[10]][1], *at[r[11]]) for r in links]
    write_dbf(folder / "link.dbf", [(f, 12) for f in fields], rows)
    write_shp(folder / "link.shp", [[(r[11], r[10]), (r[13], r[12])] for r in rows], 3)
    (folder / "ODmatrix" / "a.csv").write_text("0,3\n1,0\n")
    (folder / "ODmatrix" / "b.csv").write_text("0,2\nx,4\n")
    return folder


def test_shapefiles(spark, town):
    directed = shapefile.directed_links(shapefile.features(spark, str(town / "link.shp")))
    first = directed.orderBy("seq").collect()[:2]
    assert (first[0]["capacity"], first[1]["capacity"], first[0]["speed"], first[1]["zone"]) == (100, 9999, 30, 1)
    assert first[0]["geometry"] == first[1]["geometry"][::-1] and first[0]["from_point"] == first[1]["to_point"]
    nodes, links, zones = shapefile.read_network(spark, str(town))
    assert nodes.count() == 4 and links.count() == 8
    placed = [(r["link_id"], r["u"], r["v"], r["free_flow_time"]) for r in links.orderBy("link_id").collect()]
    assert placed[:4] == [(0, 0, 1, 15.0), (1, 1, 0, 10.0), (2, 1, 2, 30.0), (3, 2, 1, 30.0)]
    assert {r["zone"]: r["node_id"] for r in zones.collect()} == {1: 0, 2: 2}


def test_problem_from_files(spark, town):
    p = odmatrix.problem_from_shapefiles(spark, str(town))
    assert p.name == "circle"
    trips = sorted((r["source"], r["target"], r["volume"]) for r in p.demand.collect())
    assert trips == [(0, 2, 5.0)]
    found = solve(p, FrankWolfeSettings(2, 1e-4, 1e-4))
    assert sum(by_link(found.flow, "flow")) > 0
    with pytest.raises(Exception):
        odmatrix.read_directory(spark, str(town / "empty")).collect()


def test_matrix_cells(spark, town):
    cells = odmatrix.read_directory(spark, str(town / "ODmatrix"))
    assert cells.count() == 8 and cells.where("isnan(value)").count() == 1


def test_dumps_and_store(spark, tmp_path):
    paths = [(0, [1, 2]), (1, []), (70000, [65537])]
    frame = spark.createDataFrame(paths, "trip_id long, links array<long>")
    pathdump.write_paths(frame.repartition(2), str(tmp_path / "paths"))
    found = pathdump.read_paths(spark, str(tmp_path / "paths"))
    assert sorted((r["trip_id"], r["links"]) for r in found.collect()) == paths
    pathdump.write_paths(frame.where("trip_id = 1"), str(tmp_path / "paths"))
    assert found.count() == 3 and pathdump.read_paths(spark, str(tmp_path / "paths")).count() == 4
    pathdump.write_paths(frame.coalesce(1), str(tmp_path / "paths"), "overwrite")
    found = pathdump.read_paths(spark, str(tmp_path / "paths"))
    assert sorted((r["trip_id"], r["links"]) for r in found.collect()) == paths
    assert [f.name.split("-")[0] for f in (tmp_path / "paths").iterdir() if not f.name.startswith(".")] == ["part"]
    for bad in ({"number_of_links": 5}, {"number_of_trips": 1000}):
        with pytest.raises(Exception, match="out of range"):
            pathdump.read_paths(spark, str(tmp_path / "paths"), **bad).collect()

    kv = pathstore.PathStore(spark, str(tmp_path / "kv"))
    assert kv.get(b"x") is None and not kv.cursor().is_valid()
    pathdump.load_into(kv, found)
    kv.add_paths(spark.createDataFrame([(5, [1, 2])], "trip_id long, links array<long>"))
    assert sorted((r["trip_id"], r["links"]) for r in kv.paths().collect()) == [(1, []), (5, [1, 2]), (70000, [65537])]
    assert kv.get(pathstore.encode_key([1, 2])) == pathstore.encode_value(5)
    assert pathstore.decode_key(pathstore.encode_key([4, 70000])) == [4, 70000]
    cursor, seen = kv.cursor(), []
    cursor.reset()
    while cursor.is_valid():
        seen.append((cursor.counter, cursor.key(), pathstore.decode_value(cursor.value())))
        cursor.next()
    assert seen == [(0, b"", 1), (1, pathstore.encode_key([65537]), 70000), (2, pathstore.encode_key([1, 2]), 5)]
    assert [bytes(r["key"]) for r in kv.scan().orderBy("counter").collect()] == [k for _, k, _ in seen]
    kv.set(b"ab", b"\1\0\0\0")
    assert kv.get(b"ab") == b"\1\0\0\0"
    kv.close()
    kv.destroy()
    assert kv.get(b"ab") is None
    tries = pathdump.read_tries(spark, "[[0, [[3, [0, 2, 4]], [3, [1, 4]]]]]")
    assert pathflow.count_paths(tries).first()["number_of_paths"] == 2


def test_save_and_load(spark, tmp_path):
    p = braess(spark)
    found = solve(p, FrankWolfeSettings(2, 1e-6, 1e-8), keep_paths=True)
    folder = store.save_result(found, str(tmp_path / "out"), "2020-01-01T00:00:00")
    with pytest.raises(FileExistsError):
        store.save_result(found, str(tmp_path / "out"), "2020-01-01T00:00:00")
    back = store.load_result(spark, folder)
    assert by_link(back.flow, "flow") == by_link(found.flow, "flow")
    assert (back.gap, back.iterations, back.settings, back.problem.cost, back.problem.name) == (found.gap, found.iterations, found.settings, Linear(), "braess")
    assert by_link(back.improve().flow, "flow") == pytest.approx(by_link(found.improve().flow, "flow"))
    graph = store.load_graph(spark, folder + "/problem")
    assert graph.number_of_nodes == 4 and [(r["u"], r["v"]) for r in graph.links().collect()] == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    assert [tuple(r) for r in store.load_demand(spark, folder + "/problem").collect()] == [(0, 0, 3, 6.0)]
    store.write_text(spark, str(tmp_path / "c" / "cost_function.json"), '{"name": "BPR", "kwargs": {"alpha": 0.1, "beta": 2, "capacity": [1, 2], "free_flow_travel_time": [3, 4]}}')
    name, columns = store.load_cost_arrays(spark, str(tmp_path / "c"))
    assert name == "bpr" and by_link(columns, "capacity") == [1, 2] and by_link(columns, "beta") == [2.0, 2.0]


def test_sparse(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)], "row long, col long, value double")
    store.save_sparse(entries, str(tmp_path / "m"))
    back = store.load_sparse(spark, str(tmp_path / "m"))
    for by in ("col", "row"):
        data, indices, indptr, shape = store.compressed(back, by)
        assert shape == (3, 2)
        again = store.from_compressed(spark, data, indices, indptr, by)
        assert sorted(map(tuple, again.collect())) == [(0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)]


def test_graph_record(spark):
    assert DiGraph.from_links(spark, [(0, 1)], 2).info().number_of_links == 1


def test_deleted_records_go_with_their_shapes(spark, tmp_path):
    rows = [(1, 10.0, 20.0), (2, 11.0, 21.0), (3, 12.0, 22.0)]
    (tmp_path / "n.dbf").write_bytes(files.dbf([("ID", 6), ("LAT", 12), ("LON", 12)], rows, frozenset([1])))
    (tmp_path / "n.shp").write_bytes(files.shp([[(y, x)] for _, x, y in rows]))
    found = shapefile.features(spark, str(tmp_path / "n.shp")).orderBy("record").collect()
    assert [(r["record"], r["properties"]["ID"], r["geometry"][0]["y"]) for r in found] == [(0, "1", 10.0), (1, "3", 12.0)]


def test_last_of_equal_keys_in_a_batch_counts(spark, tmp_path):
    kv = pathstore.PathStore(spark, str(tmp_path / "kv"))
    kv.add_paths(spark.createDataFrame([(1, [7]), (2, [8]), (3, [7])], "trip_id long, links array<long>").coalesce(1))
    assert sorted((r["trip_id"], r["links"]) for r in kv.paths().collect()) == [(2, [8]), (3, [7])]
    kv.upsert(kv.frame().withColumn("seq", F.lit(0)))
    kv.add_paths(spark.createDataFrame([(5, [7], 9), (6, [7], 4)], "trip_id long, links array<long>, seq long"))
    assert pathstore.decode_value(kv.get(pathstore.encode_key([7]))) == 5


def test_path_sets_in_both_styles(spark):
    plain = [[0, [[3, [0, 2, 4]], [3, [1, 4]]]], [2, [[3, []]]]]
    block = "---\n# paths\n- - 0\n  - - - 3\n      - - 0\n        - 2\n        - 4\n    - - 3\n      - [1, 4]\n- - 2\n  - - - 3\n      - []\n"
    assert pathdump.parse_sequences(block) == plain == pathdump.parse_sequences(str(plain))
    tries = pathdump.read_tries(spark, block)
    assert pathdump.display(tries) == ["0 -> 3: 0 2 4", "0 -> 3: 1 4", "2 -> 3: "]


def test_compressed_files(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)], "row long, col long, value double")
    for by, kind in (("col", "csc"), ("row", "csr")):
        store.save_npz(entries, str(tmp_path / f"{by}.npz"), by)
        back, tag = store.load_npz(spark, str(tmp_path / f"{by}.npz"))
        assert tag == kind and sorted(map(tuple, back.collect())) == [(0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)]
    with pytest.raises(ValueError):
        store.save_npz(entries, str(tmp_path / "x.npz"), max_entries=2)


def test_demand_beside_its_description(spark, tmp_path):
    demand = spark.createDataFrame([(0, 0, 3, 6.0), (1, 0, 2, 1.5)], "trip_id long, source long, target long, volume double")
    store.save_demand(demand, str(tmp_path), max_rows=1)
    assert sorted(map(tuple, store.load_demand(spark, str(tmp_path)).collect())) == [(0, 0, 3, 6.0), (1, 0, 2, 1.5)]


def test_programs_are_solved(spark):
    constraints = spark.createDataFrame([(0, "=", 6.0), (1, "=", 4.0), (2, "=", 2.0), (3, "=", 0.0)], "cid long, sense string, rhs double")
    coefficients = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)], "row long, col long, value double")
    program = pathflow.LinearProgram(constraints, coefficients)
    values = program.optimize()
    assert program.get_values(values) == pytest.approx([4.0, 2.0, 0.0], abs=1e-5) and program.residual(values).first()[0] < 1e-5
    with pytest.raises(ValueError):
        pathflow.LinearProgram(constraints.replace(4.0, 9.0, ["rhs"]), coefficients).optimize(max_rounds=5)
    assert vectors.debug(values, "flow", "col") == "4 2 0"


def lined(k):
    return [(float(k), 0.5)] * (2 + k % 3)


def make_shapefile(stem, count, deleted=frozenset(), index=True):
    stem.with_suffix(".dbf").write_bytes(files.dbf([("ID", 6), ("NAME", 8)], [(k, None if k % 7 == 0 else f"r{k}") for k in range(count)], deleted))
    shapes = files.shp([lined(k) for k in range(count)])
    stem.with_suffix(".shp").write_bytes(shapes)
    if index:
        stem.with_suffix(".shx").write_bytes(files.shx(shapes))


@pytest.mark.parametrize("index", [True, False])
def test_shapefiles_in_ranges_of_records(spark, tmp_path, index):
    gone = frozenset(range(0, 3000, 11)) | frozenset(range(800))
    make_shapefile(tmp_path / "r", 3000, gone, index)
    found = shapefile.features(spark, str(tmp_path / "r.shp"), per_part=700)
    rows = found.orderBy("record").collect()
    left = [k for k in range(3000) if k not in gone]
    assert [r["record"] for r in rows] == list(range(len(left)))
    assert [r["properties"] for r in rows] == [{"ID": str(k), "NAME": None if k % 7 == 0 else f"r{k}"} for k in left]
    assert [[tuple(p) for p in r["geometry"]] for r in rows] == [lined(k) for k in left]
    whole = shapefile.records(spark, str(tmp_path / "r"), per_part=700)
    assert whole.rdd.getNumPartitions() == (5 if index else 1)


def test_shapefiles_read_what_is_asked(spark, tmp_path):
    make_shapefile(tmp_path / "r", 10)
    (tmp_path / "r.shp").unlink()
    assert shapefile.records(spark, str(tmp_path / "r"), "deleted boolean").count() == 10
    rows = shapefile.records(spark, str(tmp_path / "r"), "part int, live long, properties map<string,string>", 4, ["ID"]).collect()
    assert sorted((r["part"], r["live"], r["properties"]["ID"]) for r in rows) == [(k // 4, k % 4, str(k)) for k in range(10)]
    assert all(set(r["properties"]) == {"ID"} for r in rows)
    with pytest.raises(Exception):
        shapefile.features(spark, str(tmp_path / "r")).collect()


def test_empty_shapefiles(spark, tmp_path):
    make_shapefile(tmp_path / "r", 0)
    assert shapefile.features(spark, str(tmp_path / "r.shp")).collect() == []
    make_shapefile(tmp_path / "s", 2)
    (tmp_path / "s.shx").write_bytes((tmp_path / "s.shx").read_bytes() + b"\0" * 8)
    with pytest.raises(Exception, match="2 records and 3 shapes"):
        shapefile.features(spark, str(tmp_path / "s.shp")).collect()


def packed(*records):
    return gzip.compress(b"".join(struct.pack(f"<{len(r)}I", *r) for r in records))


def numbers(data, chunk):
    return [v for a in pathdump.whole_records(pathdump.inflate(io.BytesIO(data), chunk)) for v in a.tolist()]


def test_dumps_are_inflated_in_pieces():
    end = pathdump.END
    records = [(k, *range(k % 5), end) for k in range(50)]
    flat = [v for r in records for v in r]
    data = packed(*records[:20]) + packed() + packed(*records[20:])  # members follow each other
    for chunk in (1, 2, 3, 4, 5, 7, 64, 1 << 20):
        assert numbers(data, chunk) == flat
    long = packed((1, *[9] * 300_000, end), (2, end))
    most = max(map(len, pathdump.inflate(io.BytesIO(long), 4096)))
    assert most <= 4096 and len(numbers(long, 4096)) == 300_004
    assert numbers(packed(), 8) == numbers(b"", 8) == []


@pytest.mark.parametrize("data", [packed((1, 2)), gzip.compress(b"\1\0\0\0\2"), packed((1, 2, pathdump.END))[:-9], packed((1, 2, pathdump.END))[:5]])
def test_cut_dumps_raise(data):
    with pytest.raises((ValueError, zlib.error)):
        numbers(data, 64)


def test_dumps_without_a_trip_or_with_nulls_raise(spark, tmp_path):
    (tmp_path / "a.bin.gz").write_bytes(packed((1, pathdump.END), (pathdump.END,)))
    with pytest.raises(Exception, match="no trip"):
        pathdump.read_paths(spark, str(tmp_path / "a.bin.gz")).collect()
    for row in ((None, [1]), (1, None), (1, [None]), (-1, [1]), (1, [pathdump.END])):
        with pytest.raises(Exception):
            pathdump.write_paths(spark.createDataFrame([row], "trip_id long, links array<long>"), str(tmp_path / "b"))
    assert list((tmp_path / "b").iterdir()) == []
    (tmp_path / "none").mkdir()
    assert pathdump.read_paths(spark, str(tmp_path / "none")).count() == 0


def test_listings_are_read_by_line(spark, tmp_path):
    block = "- - 0\n  - - - 3\n      - - 0\n        - 2\n        - 4\n    - - 3\n      - [1, 4]\n- - 2\n  - - - 3\n      - []\n"
    (tmp_path / "a.yaml").write_text(block)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 24)
    try:
        found = pathdump.read_listing(spark, str(tmp_path / "a.yaml"))
        assert sorted(map(tuple, found.collect())) == [(0, 3, [0, 2, 4]), (0, 3, [1, 4]), (2, 3, [])]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pathdump.listing_lines(found).write.text(str(tmp_path / "out"))
    assert sorted(map(tuple, pathdump.read_listing(spark, str(tmp_path / "out")).collect())) == [(0, 3, [0, 2, 4]), (0, 3, [1, 4]), (2, 3, [])]
