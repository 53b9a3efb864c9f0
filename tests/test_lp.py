"""Linear programs with known optima, and ones that have none."""

import random

import pytest

from flowloom.operators import lp
from flowloom.operators.pathflow import LinearProgram, relocation_program


def rows(spark, rows):
    return spark.createDataFrame(rows, "cid long, sense string, rhs double")


def entries(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, value double")


def variables(spark, rows):
    return spark.createDataFrame(rows, "col long, cost double, lower double, upper double")


@pytest.fixture(scope="module")
def factory(spark):
    """At most 4 of the first, 6 of the second, 18 hours: 3 and 5 earned a piece."""
    return rows(spark, [(0, "<", 4.0), (1, "<", 12.0), (2, "<", 18.0)]), entries(spark, [(0, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0), (2, 0, 1.0), (2, 1, 2.0)])


def flows(solution):
    return [r["flow"] for r in solution.values.orderBy("col").collect()]


def test_an_optimum_with_its_prices(spark, factory):
    found = LinearProgram(*factory, variables(spark, [(0, -3.0, None, None), (1, -5.0, None, None)])).minimize()
    assert found.status == "optimal" and found.objective == pytest.approx(-36, abs=1e-6)
    assert flows(found) == pytest.approx([2, 6], abs=1e-5)
    assert [r["price"] for r in found.prices.orderBy("cid").collect()] == pytest.approx([0, -1.5, -1], abs=1e-5)


def test_bounds_and_a_variable_without_a_row(spark, factory):
    found = LinearProgram(*factory, variables(spark, [(0, -3.0, 0.0, 1.0), (1, -5.0, None, None), (7, 1.0, -2.0, None)])).minimize()
    assert flows(found) == pytest.approx([1, 6, -2], abs=1e-5) and found.objective == pytest.approx(-35, abs=1e-6)


def test_blocks_take_the_same_steps(spark, factory):
    own = variables(spark, [(0, -3.0, None, None), (1, -5.0, None, None)])
    one, many = (lp.minimize(*factory, own, tolerance=1e-12, max_steps=20, block=b) for b in (lp.BLOCK, 2))
    assert one.status == many.status == "rounds" and one.steps == many.steps == 20
    assert flows(one) == pytest.approx(flows(many), rel=1e-9)


def test_a_certificate_of_no_point(spark):
    program = rows(spark, [(0, "=", 5.0), (1, "<", 3.0)]), entries(spark, [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)])
    found = lp.minimize(*program)
    price = {r["cid"]: r["price"] for r in found.prices.collect()}
    assert found.status == "infeasible"
    # Weighted by the prices the rows ask for more than 0, but no variable adds to their sum.
    size = max(map(abs, price.values()))
    assert price[1] <= 0 < 5 * price[0] + 3 * price[1] and price[0] + price[1] <= 1e-3 * size
    crossed = lp.minimize(*program, variables(spark, [(0, 0.0, 2.0, 1.0)]))
    assert crossed.status == "infeasible"


def test_a_direction_without_end(spark):
    found = lp.minimize(rows(spark, [(0, ">", 1.0)]), entries(spark, [(0, 0, 1.0), (0, 1, 1.0)]), variables(spark, [(0, -1.0, None, None)]))
    assert found.status == "unbounded" and found.objective < 0


def test_rows_without_entries_and_unknown_rows(spark):
    none = entries(spark, [])
    assert lp.minimize(rows(spark, [(0, "<", 1.0)]), none, variables(spark, [(0, 1.0, 2.0, None)])).objective == pytest.approx(2)
    assert lp.minimize(rows(spark, [(0, ">", 1.0)]), none, variables(spark, [(0, 1.0, 2.0, None)])).status == "infeasible"
    with pytest.raises(ValueError):
        lp.minimize(rows(spark, [(0, "=", 1.0)]), entries(spark, [(5, 0, 1.0)]))
    with pytest.raises(ValueError):
        lp.minimize(rows(spark, [(0, "~", 1.0)]), entries(spark, [(0, 0, 1.0)]))


def test_relocation_on_a_line(spark):
    """Between neighbours on a line the least moves are the sums of what lies on one side."""
    rng = random.Random(3)
    surplus = [float(rng.randrange(-9, 10)) for _ in range(11)]
    surplus.append(-sum(surplus))
    roads = [(2 * i + k, i + k, i + 1 - k, 1.0) for i in range(11) for k in (0, 1)]
    program = relocation_program(spark.createDataFrame(list(enumerate(surplus)), "node long, surplus double"), spark.createDataFrame(roads, "link_id long, u long, v long, cost double"))
    expected = sum(abs(sum(surplus[: i + 1])) for i in range(12))
    assert program.minimize(1e-9).objective == pytest.approx(expected, rel=1e-6)


def test_programs_grow_and_are_written(spark, factory, tmp_path):
    program = LinearProgram(*factory).add_variables(variables(spark, [(0, -3.0, None, None), (1, -5.0, None, 4.0)]), entries(spark, []))
    program = program.add_constraints(rows(spark, [(9, ">", 1.0)])).add_variables(variables(spark, [(5, 2.0, 1.0, None)]), entries(spark, [(9, 5, 1.0)]))
    assert (program.n_constraints(), program.n_variables()) == (4, 3)
    program.write(str(tmp_path / "lp"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lp")).collect()]
    for line in (" + -5.0 x1", " c9: x5 >= 1.0", " 0 <= x1 <= 4.0", " 1.0 <= x5 <= inf", "Bounds"):
        assert line in lines
    assert flows(program.minimize()) == pytest.approx([10 / 3, 4, 1], abs=1e-5)
