"""The registered matrices have a column for every product of the data."""

from __future__ import annotations

from checks import queries
from stockloom.plans import exploration


def test_no_product_is_dropped(spark):
    rounds = spark.createDataFrame(
        [("A", 1, "Brand#10", 1.0), ("A", 1, "Brand#2", 2.0), ("A", 1, "Other#1", 4.0)], "company string, round long, product string, demand double"
    )
    found = queries._products(exploration.demand_matrix)(rounds)
    assert found.columns == ["company", "round", "Brand#2", "Other#1", "Brand#10"]


def test_blocks_hold_any_number_of_products(spark):
    """30,000 products of one company, a null product, a company with one."""
    rounds = spark.range(30_000).selectExpr("'A' company", "id % 2 round", "cast(id as string) product", "cast(id as double) demand")
    rounds = rounds.unionByName(spark.createDataFrame([("A", 0, None, 9.0), ("A", 0, "2", 0.5), ("B", 5, "2", None)], "company string, round long, product string, demand double"))
    found = exploration.matrix_blocks(rounds, "demand", 7).collect()
    names = sorted(str(i) for i in range(30_000))
    want = {("A", i % 2, names.index(str(i)) // 7) for i in range(0, 30_000, 1000)} | {("B", 5, 0)}
    cells = {(r.company, r["round"], r.block): r.cells for r in found}
    assert len(cells) == len(found) and want <= set(cells)
    assert {key[2] for key in cells if key[0] == "A"} == set(range(-(-30_000 // 7)))
    place = {name: at for at, name in enumerate(names)}
    assert all(place[p] // 7 == key[2] and int(p) % 2 == key[1] for key, of in cells.items() if key[0] == "A" for p in of)
    assert sum(len(of) for key, of in cells.items() if key[0] == "A") == 30_000
    assert cells["A", 0, place["2"] // 7]["2"] == 2.5 and cells["B", 5, 0] == {"2": None}
    assert exploration.matrix_blocks(rounds.limit(0), "demand").count() == 0
