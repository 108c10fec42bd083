"""Shortlists of candidates against all cosines; names of containers."""

import math
import random

from litmill.operators import library, retrieval


def test_prefiltered(spark):
    rng = random.Random(2)
    bag = lambda: {b: rng.choice([-2.0, 1.0, 3.0]) for b in rng.sample(range(40), rng.choice([1, 2, 6]))}
    profiles, candidates = {i: bag() for i in range(30)}, {f"c{i:02}": bag() for i in range(25)}
    candidates["c98"] = candidates["c99"] = candidates["c03"]
    rows = lambda bags: [(k, b, x) for k, v in bags.items() for b, x in v.items()]
    p, c = spark.createDataFrame(rows(profiles), "id long, bucket int, x double"), spark.createDataFrame(rows(candidates), "label string, bucket int, x double")

    def cosine(u, v):
        return max(0.0, round(sum(x * v.get(b, 0.0) for b, x in u.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())), 6))

    for most in (1, 5, 20, 100):
        want = {(i, k, place) for i, u in profiles.items() for place, (_, k) in enumerate(sorted((-cosine(u, v), k) for k, v in candidates.items())[:most], 1)}
        got = retrieval.prefiltered(p, c, most)
        assert {(r.id, r.label, r.place) for r in got.collect()} == want and got.count() == len(want)
    assert retrieval.prefiltered(p, c.limit(0), 5).count() == 0 and retrieval.prefiltered(p.limit(0), c, 5).count() == 0


def test_containers_are_seen_by_way_of_shelves(spark):
    make = spark.createDataFrame
    links = make([(1, 10), (1, 11), (2, 11), (3, 12), (4, 13)], "work_id long, shelf_id long")
    shelves = make([(10, 1, "b"), (11, 2, "a"), (13, 3, "d")], "shelf_id long, rack_id long, name string")  # 12 is not seen
    racks = make([(1, 7, "r1"), (2, 8, None)], "rack_id long, row_id long, name string")  # rack 3 is not seen
    rows = make([(7, "w")], "row_id long, name string")  # row 8 is not seen
    got = library.containers(links, shelves, racks, rows)
    want = {(1, "shelf", 10, "b"), (1, "shelf", 11, "a"), (2, "shelf", 11, "a"), (4, "shelf", 13, "d"), (1, "rack", 1, "r1"), (1, "row", 7, "w")}
    assert {tuple(r) for r in got.collect()} == want | {(1, "rack", 2, None), (2, "rack", 2, None)}
    none = make([], "id long")
    works = make([(i,) for i in range(1, 5)], "id long")
    keys = library.sortable(works, none.selectExpr("id citing_id", "id cited_id"), none.selectExpr("id work_id"), got)
    assert {(r.id, r.shelves, r.racks, r.rows) for r in keys.collect()} == {(1, "a", "r1", "w"), (2, "a", None, None), (3, None, None, None), (4, "d", None, None)}
    assert [r.id for r in keys.orderBy(*library.order("shelves:desc", ["shelves"])).collect()] == [4, 1, 2, 3]
