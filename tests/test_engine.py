"""Rules, extraction, ingest and streams on small tables; every query with SQL against DuckDB."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from offerlake import queries
from offerlake.functions import rules, scalars
from offerlake.operators import builder, catalog, ingest, maintain, normalize, schedule
from offerlake.plans import views
from offerlake.sources import extract, state
from offerlake.streaming import cycle, observe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(row):
    return tuple(repr(float(x)) if isinstance(x, (float, int)) and not isinstance(x, bool) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(plain, got.select(*cols).collect())) == sorted(map(plain, want))


def one(spark, sql, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(rules.column(sql).alias("x")).first().x


def test_known_titles(spark):
    cpu, gpu = "amd ryzen 7 7800x3d 8-core desktop processor am5 120w", "msi gaming geforce rtx 5080 16g gddr7"
    assert one(spark, rules.category_sql(), t=cpu) == "CPU" and one(spark, rules.category_sql(), t=gpu) == "GPU"
    assert one(spark, rules.SPECS["cpu"]["socket"], t=cpu) == "AM5" and one(spark, rules.SPECS["cpu"]["cores"], t=cpu) == 8
    assert one(spark, rules.SPECS["gpu"]["chipset"], t=gpu) == "RTX 5080" and one(spark, rules.SPECS["gpu"]["memory_size_gb"], t=gpu) == 16
    assert one(spark, rules.SPECS["ssd"]["capacity_gb"], t="2 tb nvme") == 2000
    assert one(spark, rules.category_sql(), t="cpu cooler") == "CPU"


#: kind, column, text, expected value.
SPEC_CASES = [
    ("cpu", "socket", "core i7 14th", None), ("cpu", "socket", "core i7 14th gen", "LGA1700"), ("cpu", "socket", "core ultra 9", "LGA1851"), ("cpu", "threads", "16 threads", 16), ("cpu", "tdp", "65 w", 65),
    ("gpu", "chipset", "palit 5090", None), ("gpu", "chipset", "rtx 5070 ti", "RTX 5070 Ti"), ("gpu", "chipset", "rtx 5070ti", "RTX 5070"), ("gpu", "recommended_psu", "rtx 5060 ti", 650), ("gpu", "memory_type", "rtx", "GDDR6"),
    ("motherboard", "form_factor", "tuf b650 micro atx", "ATX"), ("motherboard", "form_factor", "mini board", "ATX"), ("motherboard", "form_factor", "eatx", "E-ATX"), ("motherboard", "form_factor", "matx", "Micro-ATX"), ("motherboard", "memory_type", "b760 ddr4", "DDR4"), ("motherboard", "socket", "x850", None),
    ("ram", "memory_type", "16 gb", "DDR5"), ("ram", "speed_mhz", "6000 mhz", 6000), ("psu", "efficiency_rating", "gold platinum", "80+ Platinum"), ("psu", "wattage", "50w 850w", 850),
    ("cabinet", "form_factor", "itx", "Mini-ITX"), ("cabinet", "form_factor", "matx", "Micro-ATX"), ("cabinet", "form_factor", "micro atx", "Mid Tower"), ("cabinet", "form_factor", "super tower", "Full Tower"),
    ("cooler", "cooler_type", "360 fan", "Air"), ("cooler", "radiator_size_mm", "360 fan", 360), ("ssd", "interface", "gen3", "M.2 NVMe"), ("ssd", "interface", "hdd", "SATA"), ("ssd", "capacity_gb", "512gb", 512),
    ("monitor", "resolution", "4k", "3840x2160"), ("monitor", "resolution", "2560x1440", "2560x1440"), ("monitor", "resolution", "1920x1080", "1920x1080"), ("monitor", "refresh_rate_hz", "165hz", 165),
]


def test_specification_rules_by_literal_values(spark):
    for kind, column, text, want in SPEC_CASES:
        assert one(spark, rules.SPECS[kind][column], t=text) == want, (kind, column, text)
    graphics = rules.SPECS["cpu"]["integrated_graphics"]
    assert [one(spark, graphics, name=n, t=n.lower()) for n in ("i5-14400F", "i5 F", "i5 f", "f x", "i5 no graphics")] == [True, True, False, False, False]


def test_kinds_are_exact_names(spark):
    names = ["CPU", "CPU Cooler", "Processor", "AMD Processor", "Laptop RAM", "Laptop RAM (DDR5)", "Program", "External HDD", "Curved Monitor", "Cabinet", "Graphics Card", "Accessories"]
    rows = spark.createDataFrame([(n,) for n in names], "c string").select("c", rules.kind_of(F.col("c")).alias("k"), rules.kind_of(F.col("c"), granular=True).alias("g")).collect()
    assert {r.c: (r.k, r.g) for r in rows} == {
        "CPU": ("cpu", "cpu"), "CPU Cooler": ("cooler", "cooler"), "Processor": ("cpu", "cpu"), "AMD Processor": (None, "cpu"), "Laptop RAM": ("ram", "ram"), "Laptop RAM (DDR5)": (None, "ram"),
        "Program": (None, None), "External HDD": ("ssd", "ssd"), "Curved Monitor": ("monitor", "monitor"), "Cabinet": ("cabinet", "cabinet"), "Graphics Card": ("gpu", "gpu"), "Accessories": (None, None),
    }


def test_classifier_reads_raw_category_and_url(spark):
    rows = [(1, "thing", "Gaming Mouse", None, None), (2, "thing", None, "https://x.in/product/monitor/a", None), (3, "thing", None, None, None)]
    got = normalize.classified(spark.createDataFrame(rows, "id long, name string, category string, product_url string, specifications string"))
    assert {r.id: r.coded for r in got.collect()} == {1: "Mouse", 2: "Monitor", 3: "Accessories"}
    typed = spark.createDataFrame([(1, "Zotac card", "GPU", "", '{"chip": "RTX 5070 Ti"}')], "id long, name string, category string, product_url string, specifications string")
    (r,) = normalize.normalized(typed).collect()
    assert (r.kind, r.gpu.chipset, r.cpu) == ("gpu", "RTX 5070 Ti", None)
    after, tables = normalize.upsert(typed, {"gpu": spark.createDataFrame([(1, "old", 4, None, "GDDR6"), (2, "x", 1, 1, "y")], "product_id long, chipset string, memory_size_gb int, recommended_psu int, memory_type string")})
    assert {(x.product_id, x.chipset, x.memory_size_gb) for x in tables["gpu"].collect()} == {(1, "RTX 5070 Ti", 16), (2, "x", 1)} and after.first().category == "GPU"


ITEM = "build_id long, product_id long, name string, sid long, price decimal(12,2), t string, kind string, socket string, memory_type string, tdp int, recommended_psu int, wattage int, length_mm int, max_gpu_length_mm int, supported_sockets string"


def item(build, product, name, kind=None, price=None, sid=1, **specs):
    given = [specs.get(c) for c in ("socket", "memory_type", "tdp", "recommended_psu", "wattage", "length_mm", "max_gpu_length_mm", "supported_sockets")]
    return (build, product, name, sid, None if price is None else Decimal(price), name.lower(), kind, *given)


def test_build_validation_by_literal_values(spark):
    rows = [
        item(1, 1, "Ryzen 7 AM5 DDR5", "cpu", 100, socket="AM5", tdp=105), item(1, 2, "Board LGA1700 DDR4", "motherboard", 50, socket="lga1700", memory_type="DDR4"), item(1, 3, "Memory DDR5", "ram", None, memory_type="DDR5"),
        item(1, 4, "RTX 5090", "gpu", 0, 2, recommended_psu=1000, length_mm=350), item(1, 5, "Corsair PSU 550w", "psu", 10, wattage=550), item(1, 6, "Case", "cabinet", 5, max_gpu_length_mm=300), item(1, 7, "Cooler", "cooler", 5, supported_sockets="lga1700"),
        item(2, 8, "Ryzen 5 AM4", "cpu", 80, socket="AM4"), item(2, 9, "Board AM4", "motherboard", 60, socket="am4", memory_type=""), item(2, 10, "Kit", "ram", 1, memory_type="DDR4"), item(2, 11, "Box", "cabinet", 1, max_gpu_length_mm=0), item(2, 12, "Card", "gpu", 1, length_mm=500),
    ]
    one_, two = builder.validate(spark.createDataFrame(rows, ITEM)).orderBy("build_id").collect()
    assert [n.message for n in one_.notices] == [
        "Socket Mismatch Detected: Selected components reference multiple incompatible sockets (AM5, LGA1700).",
        "RAM Generation Mismatch: Build mixes incompatible memory standards (DDR4, DDR5).",
        "Power Supply Capacity Warning: Selected 550W PSU is close to or below recommended head-room for 725W estimated build draw.",
        "Socket Mismatch: CPU socket (AM5) is incompatible with Motherboard socket (lga1700).",
        "RAM Standard Mismatch: Motherboard supports DDR4, but selected RAM is DDR5.",
        "PSU Capacity Warning: GPU recommends at least 1000W PSU, but selected PSU is 550W.",
        "GPU Clearance Error: GPU length (350mm) exceeds Cabinet max clearance (300mm).",
        "Cooler Mounting Check: Verify cooler mounting kit supports AM5 socket.",
    ]
    assert [n.level for n in one_.notices] == ["error", "error", "warning", "error", "error", "warning", "error", "warning"]
    assert (one_.compatible, one_.estimated_wattage, one_.total_min_cost, one_.n_items) == (False, 105 + 250 + 50, 170, 7)
    assert (two.compatible, two.notices, two.estimated_wattage, two.total_min_cost) == (True, [], 120 + 250 + 50, 143)
    stores = spark.createDataFrame([(1, "A", True), (2, "B", True), (3, "C", False)], "id long, display_name string, active boolean")
    of_one = builder.store_breakdown(spark.createDataFrame(rows[:7], ITEM), stores)
    assert sorted(map(tuple, of_one.collect())) == [(1, "A", 170.0, 5), (2, "B", 0.0, 0)]
    assert [s[0] for s in builder.SLOTS] == ["cpu", "motherboard", "gpu", "ram", "storage", "psu", "case"] and [s[0] for s in builder.SLOTS if not s[2]] == ["gpu", "case"]


def test_build_validation_reads_its_tables_once(spark):
    plan = queries.validate_builds(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2
    assert builder.validate(spark.createDataFrame([], ITEM)).count() == 0


def test_pages_stop_at_a_gap(spark):
    rows = [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 2, 2), (1, 1, 1, 2), (1, 1, 3, 4), (2, 1, 1, 2), (3, 1, 1, 1), (3, 1, 1, 2), (3, 1, 2, 3)]
    batch = spark.createDataFrame(rows, "target_id long, sid long, pid long, page int")
    assert sorted(map(tuple, ingest.until_stop(batch).select("target_id", "pid", "page").collect())) == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (3, 1, 1)]
    assert ingest.until_stop(batch, 1).count() == 3


def test_marks_leave_other_targets(spark):
    t0, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    targets = spark.createDataFrame([(1, 9, 2, t0, t0), (2, 9, 1, t0, t0), (3, 8, 0, t0, None), (4, 8, 0, t0, t0)], "id long, store_id long, schedule_type int, next_scrape_at timestamp_ntz, last_scraped_at timestamp_ntz")
    got = {r.id: (r.next_scrape_at, r.last_scraped_at) for r in schedule.mark_scraped(targets, targets.filter("id in (1, 3)"), F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {1: (now + dt.timedelta(hours=1), now), 2: (t0, t0), 3: (now + dt.timedelta(days=1), now), 4: (t0, t0)}
    got = {r.id: (r.next_scrape_at, r.last_scraped_at) for r in schedule.reset(targets, 8, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {1: (t0, t0), 2: (t0, t0), 3: (now, None), 4: (now, None)}


def test_ids_are_dense_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ingest, "GROUP_ROWS", 7)
    keys = sorted({(s, p * p % 101) for s in range(4) for p in range(60)})
    got = ingest.with_ids(spark.createDataFrame(keys[::-1], "sid long, pid long").repartition(5), 10).orderBy("id").collect()
    assert [(r.sid, r.pid) for r in got] == keys and [r.id for r in got] == list(range(11, 11 + len(keys)))


def test_cycle_enriches_and_chains(spark, tmp_path):
    products = spark.createDataFrame([(k, 1, k, None if k % 2 else "d", None) for k in range(30)], "id long, sid long, pid long, description string, specifications string")
    details = spark.createDataFrame([(1, k, f"about {k}", None) for k in range(5, 25)], "sid long, pid long, description string, specifications string")
    got = {r.id: r.description for r in cycle.enrich(products, details).collect()}
    assert got[5] == "about 5" and got[6] == "about 6" and got[9] == "about 9" and got[11] is None and len(got) == 30
    seen = []
    stream = spark.readStream.schema("k long").parquet(str(tmp_path))
    spark.range(3).withColumnRenamed("id", "k").write.mode("append").parquet(str(tmp_path))
    cycle.every(stream, cycle.steps(lambda df, n: seen.append(("a", df.count())), lambda df, n: seen.append(("b", df.count()))), str(tmp_path / "_cp"), None).awaitTermination(60)
    assert seen == [("a", 3), ("b", 3)]


def test_merge_moves_history_and_links(spark):
    p = spark.createDataFrame([(1, 7, "a-x"), (2, 7, "a"), (3, 7, "b"), (4, 8, "a-x")], "id long, sid long, pid string")
    h = spark.createDataFrame([(1, "h1"), (2, "h2"), (4, "h4")], "product_id long, at string")
    links = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "product_id long, target_id long")
    got = maintain.merge(p, h, links, F.split_part("pid", F.lit("-"), F.lit(1)))
    assert {(r.id, r.pid) for r in got["products"].collect()} == {(2, "a"), (3, "b"), (4, "a")}
    assert sorted((r.product_id, r["at"]) for r in got["history"].collect()) == [(2, "h1"), (2, "h2"), (4, "h4")]
    assert sorted((r.product_id, r.target_id) for r in got["links"].collect()) == [(2, 10), (2, 11)]


def test_views_reach_the_rules(spark):
    assert len(views.TITLES) * len(views.ENDINGS) > 500


def test_prices_and_slugs(spark):
    prices = ["₹1,23,456", "N/A", "", None, " 99.5 "]
    rows = spark.createDataFrame([(p,) for p in prices], "p string").select(scalars.clean_price(F.col("p")).cast("double")).collect()
    assert [r[0] for r in rows] == [123456, 0, 0, 0, 99.5]
    urls = {"https://x.in/product/ram/kit-a/?v=1": "kit-a", "https://x.in/product/kit-b/ram": "kit-b", "https://x.in/product/kit-c": "kit-c", "https://x.in/items/9/": "9", "": 'my-27"-name'}
    urls |= {f"https://x.in/product/{c}/kit": "kit" for c in ("gen4-ssd", "Desktop-RAM", "internal-hdd", "hard-drive", "smps")} | {"https://x.in/product/keyboard/kit": "keyboard"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", scalars.slug(F.col("u"), F.lit('My 27" Name')).alias("s")).collect()
    assert {r.u: r.s for r in got} == urls


def page(spark, content):
    return spark.createDataFrame([(1, 7, "https://s.in/", content), (2, 7, "https://s.in/", "no json"), (3, 7, "https://s.in/", None)], "page_id long, sid long, base_url string, content string")


def test_extraction(spark):
    shop = {"products": [{"title": " A ", "handle": "a", "images": [{"src": "i"}], "variants": [{"price": "10.50", "compare_at_price": "", "available": False}, {"price": "1", "available": True}]}, {"title": "B", "handle": "b", "variants": []}]}
    (r,) = extract.shopify(page(spark, json.dumps(shop))).collect()
    assert (r.name, r.pid, float(r.price), float(r.mrp), r.in_stock, r.url) == ("A", "a", 10.5, 10.5, True, "https://s.in/products/a")
    fleet = {"products": {"data": [{"name": "A", "slug": "a", "in_stock": True, "is_out_of_stock": False, "special_price": {"amount": 0}, "price": {"amount": "9"}}, {"name": "B", "slug": "b", "in_stock": False, "price": {"amount": "1"}}]}}
    assert [(x.pid, float(x.price)) for x in extract.fleetcart(page(spark, json.dumps(fleet))).collect()] == [("a", 9)]
    fleet = {"products": {"data": [{"name": " Z ", "slug": " z ", "in_stock": True, "special_price": {"amount": 0.0}, "price": {"amount": "12.5"}, "base_image": {"path": "i"}}, {"name": "T", "slug": "t", "in_stock": True, "price": {"amount": "0"}, "base_image": []}, {"name": "U", "slug": "u", "in_stock": True, "price": {"amount": 0}}]}}
    assert [(x.pid, x.name, float(x.price), x.image) for x in extract.fleetcart(page(spark, json.dumps(fleet))).collect()] == [("z", "Z", 12.5, "i"), ("t", "T", 0, None)]
    payload = '{"productData":{"x":1,"data":[{"name":"N","slug":"n","stockStatus":"InStock","salePrice":"5","regularPrice":"8"},{"name":"O","slug":"o","price":"5"}]}}'
    for text in (payload, payload.replace('"', '\\"')):
        assert [(x.pid, float(x.price), float(x.mrp)) for x in extract.next_payload(page(spark, "<script>" + text)).collect()] == [("n", 5, 8)]
    ld = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Product","name":"P","brand":{"name":"B"},"sku":"s1","offers":{"price":"7","availability":"http://schema.org/InStock"}}</script>'
    (p,) = extract.json_ld(page(spark, ld)).collect()
    assert (p.name, p.sku, p.brand, float(p.price), p.in_stock) == ("P", "s1", "B", 7, True)
    html = spark.createDataFrame([(1, '<p><a href="/product/x">View <b>it</b></a><a>n</a>')], "page_id long, html string")
    assert [(x.href, x.text) for x in extract.anchors(html).collect()] == [("/product/x", "View it"), ("", "n")]


def test_stock_guards_and_repeat(spark):
    schema = "sid long, pid long, price decimal(12,2), mrp decimal(12,2), in_stock boolean, scraped_at timestamp_ntz"
    state = spark.createDataFrame([(1, 1, Decimal(5), Decimal(9), True, None)], schema)
    batch = spark.createDataFrame([(1, k, Decimal(5 - k), None, stock, None) for k, stock in ((1, None), (2, None), (3, False), (4, True))], schema)
    saved = ingest.save_offers(state, batch)
    assert sorted((r.pid, int(r.price), r.mrp and int(r.mrp), r.in_stock) for r in saved.collect()) == [(1, 4, 9, True), (4, 1, None, True)]
    assert sorted((r.pid, r.in_stock) for r in ingest.history_rows(saved, batch).collect()) == [(1, True), (4, True)]
    again = ingest.save_offers(saved.drop("touched"), batch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, saved.collect()))
    products = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, in_stock boolean")
    assert {r.id for r in maintain.purge(products, {}, ~F.col("in_stock"))["products"].collect()} == {1, 3}
    with pytest.raises(ValueError):
        catalog.page(products, 0)


def test_stream_equals_batch(spark, tmp_path):
    schema = "sid long, pid long, price double, scraped_at timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, k % 5, float(k % 5), t) for k in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = observe.snapshots(observe.observations(spark, str(tmp_path / "in"), schema))
    observe.run(stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.pid for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_versions_are_one_unit_of_work(spark, tmp_path):
    root = str(tmp_path / "state")
    one_, two = (spark.range(n).withColumnRenamed("id", "k") for n in (3, 5))
    assert state.versions(spark, root) == []
    assert state.save(spark, root, {"a": one_, "b": two}) == 1
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("k"))
    with pytest.raises(Exception):
        state.save(spark, root, {"a": two, "b": bad})
    assert state.versions(spark, root) == [1] and state.load(spark, root, "a").count() == 3  # nothing of the failed attempt shows
    assert state.save(spark, root, {"a": two, "b": one_}) == 2
    assert (state.load(spark, root, "a").count(), state.load(spark, root, "a", 1).count()) == (5, 3)
    with pytest.raises(ValueError):
        state.load(spark, root, "a", 7)


def test_seeds_are_whole_targets(spark):
    stores = spark.createDataFrame([(1, True), (2, False)], "id long, active boolean")
    there = spark.createDataFrame([(1, 0, "rtx 5090"), (1, 1, "4k monitor")], "store_id long, target_type int, target_value string")
    got = schedule.seed_targets(stores, there, F.lit(dt.datetime(2024, 1, 1))).collect()
    assert len(got) == 39 and {r.store_id for r in got} == {1} and {(r.target_type, r.schedule_type, r.priority, r.enabled) for r in got} == {(0, 1, 1, True)}
    assert "rtx 5090" not in {r.target_value for r in got}
