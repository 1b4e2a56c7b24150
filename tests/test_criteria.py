"""Criteria trees: null rules, each node, refused and ignored keys."""

import datetime as dt

import pytest

from parcelspark.plans import criteria as c

ROWS = [(1, "Boone ", "100", 3, 37.0, -81.0, dt.date(2001, 7, 1), "Big POOL", None), (2, None, "x", None, None, -81.0, None, None, "a pool"), (3, "BOONE", None, 5, 37.2, -81.0, dt.date(1999, 1, 1), None, None), (4, "", "250.5", 1, 37.0, -80.9, dt.date(2001, 8, 9), "100% a_b", None)]
SCHEMA = "id long, city string, price string, beds int, lat double, lng double, day date, said string, noted string"


@pytest.mark.parametrize(("node", "want"), [
    (c.OneOf("city", (" boone",)), {1, 3}), (c.Not(c.OneOf("city", ("boone",))), {4}), (c.Between(("price",), 100, 200), {1}), (c.Between(("price", "beds"), 3, None), {1, 3, 4}), (c.Between(("beds",), None, 3), {1, 4}), (c.Not(c.Between(("beds",), 2, 4)), {3, 4}),
    (c.Contains(("said", "noted"), "pool"), {1, 2}), (c.Not(c.Contains(("said", "noted"), "Pool")), {4}), (c.Contains(("said",), "%"), {4}), (c.Contains(("said",), "a_b"), {4}), (c.Contains(("said",), "axb"), set()),
    (c.Within("day", 60), {1, 4}), (c.Near(37.0, -81.0, 6.0), {1, 4}), (c.Near(37.0, -81.0, 1.0), {1}), (c.Given("city"), {1, 3}), (c.All(()), {1, 2, 3, 4}), (c.Any(()), set()), (c.Any((c.Given("city"), c.Contains(("noted",), "pool"))), {1, 2, 3}), (c.All((c.Given("city"), c.Not(c.Between(("price",), 0, None)))), set()),
])
def test_nodes(spark, node, want):
    assert {r.id for r in spark.createDataFrame(ROWS, SCHEMA).filter(c.compiled(node, "2001-08-02")).collect()} == want


def test_names():
    with pytest.raises(ValueError, match="garage"):
        c.watch_criteria({"garage": 1})
    assert set(c.watch_criteria({})) == {"classes", "statuses"}
    assert "radius" not in c.watch_criteria({"center_lat": 1.0, "center_lng": 1.0}) and "radius" not in c.watch_criteria({"center_lat": 1.0, "center_lng": 1.0, "radius_mi": 0})
    with pytest.raises(TypeError):
        c.compiled("city = 1", "2001-08-02")
    odd = c.structured({"status": "Sold", "garage": 2, "keywords": "pool", "max_beds": 3, "city": None})
    assert odd == c.All((c.Given("address"),))
    assert len(c.structured({"keywords": list("abcdef")}).parts) == 5
