"""JDBC in ranges, against the embedded database that comes with Spark."""

import pytest

from offerlake.sources import jdbc


@pytest.mark.parametrize("least, most, n", [(0, 0, 4), (-3, 9, 4), (1, 3, 8), (None, None, 4), (5, 5_000_000_007, 3)])
def test_ranges_cover_each_row_once(least, most, n):
    made = jdbc.ranges("k", least, most, n)
    fits = lambda text, k: eval(text.replace("IS NULL", "is None").replace("AND", "and").replace("OR", "or").replace(" = ", " == ")) if k is not None else "NULL" in text or text == "1 = 1"
    values = [None] if least is None else [None, least - 1, least, (least + most) // 2, most, most + 1]
    assert all(sum(bool(fits(p, k)) for p in made) == 1 for k in values) and len(made) <= n


def test_table_comes_back_in_ranges_with_pushed_filters(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k if k else None, f"n{k}") for k in range(100)]
    jdbc.save(spark.createDataFrame(rows, "ID long, NAME string").coalesce(1), url, "SHOPS", **driver)
    got = jdbc.table(spark, url, "SHOPS", "ID", 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    few = got.filter("ID > 97").select("NAME")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,97)]" in plan and "ReadSchema: struct<NAME:string>" in plan
    assert sorted(r.NAME for r in few.collect()) == ["n98", "n99"]
    assert jdbc.table(spark, url, "SHOPS", **driver).count() == 100
    jdbc.save(got.limit(0), url, "EMPTY_ONE", **driver)
    assert jdbc.table(spark, url, "EMPTY_ONE", "ID", 4, **driver).count() == 0
