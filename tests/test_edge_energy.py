"""Edge energy of pictures held as arrays, against loops over their pixels."""

import functools
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions import images
from reelspark.plans import detail


def by_loops(pixels, side):
    """The same sums in the same order, pixel by pixel; null where a pixel is missing."""
    if pixels is None or None in pixels or len(pixels) < side * side or side < 2:
        return None
    inside = lambda i: -i if i < 0 else 2 * (side - 1) - i if i >= side else i
    at = lambda x, y: pixels[inside(y) * side + inside(x)]
    bends = [at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - 4 * at(x, y) for y in range(side) for x in range(side)]
    mean = lambda values: functools.reduce(operator.add, values, 0.0) / len(values)  # sum() of floats would round otherwise
    m, square, gray = mean(bends), mean([b * b for b in bends]), mean(pixels)
    return (square - m * m) / (gray * gray + 1e-6)


@pytest.mark.parametrize("side", (1, 2, 3, 5, 32))
def test_edge_energy_equals_loops_on_odd_pictures(spark, side):
    rng, n = random.Random(side), side * side
    made = lambda size: [rng.choice((rng.uniform(-5, 300), float(rng.randrange(256)))) for _ in range(size)]
    odd = made(n), made(n)
    odd[0][rng.randrange(n)], odd[1][rng.randrange(n)] = None, math.nan
    pictures = [made(n), made(n), made(n + 3), made(n + 3)[:-1] + [None], *odd, None, [0.0] * n, [7.0] * n, *([made(n - 1)] if n > 1 else [])]
    pictures.append(pictures[0])  # the same picture twice
    ids = [None, 1, 1, *range(3, len(pictures))]  # a null id and a repeated one
    given = spark.createDataFrame([*zip(range(len(pictures)), ids, pictures)], "row int, id int, pixels array<double>")
    got = {r["row"]: (r["id"], r["e"]) for r in given.select("row", "id", images.edge_energy(F.col("pixels"), side).alias("e")).collect()}
    want = {k: (i, by_loops(p, side)) for k, (i, p) in enumerate(zip(ids, pictures))}
    assert {k: (i, repr(e)) for k, (i, e) in got.items()} == {k: (i, repr(e)) for k, (i, e) in want.items()}


def test_no_pixel_reckons_where_its_neighbours_stand(spark):
    """Places are constants of the plan: no row holds a division, a remainder or a case for them."""
    given = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id int, pixels array<double>")
    plan = given.select(images.edge_energy(F.col("pixels"), 2).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("FLOOR", "pmod", "CASE WHEN", "split") if x in plan]


def test_gate_keeps_rows_as_they_come(spark):
    """Repeated and null ids stay, a null vector has no energy and does not pass."""
    vector = [((7 * i) % 13 - 6) / 40 for i in range(64)]
    flat = [0.0] * 64
    given = spark.createDataFrame([(1, vector), (1, vector), (None, vector), (2, None), (3, flat)], "id long, embedding array<float>")
    got = sorted((r["id"] is None, r["id"] or 0) for r in detail.crop_sharpness(given).collect())
    assert got == [(False, 1), (False, 1), (True, 0)]
