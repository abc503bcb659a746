"""Versions under two writers, replayed batches, the stateful schedule, ticks, cascades and breakdowns on small tables."""

import datetime as dt
import json
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake import queries
from offerlake.operators import builder, maintain, schedule
from offerlake.sources import state
from offerlake.streaming import scheduler, tick

T = dt.datetime(2024, 1, 1)


def rows(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "k long")


def test_of_two_writers_one_wins_and_one_starts_again(spark, tmp_path):
    root, seen = str(tmp_path / "s"), []
    state.save(spark, root, {"a": rows(spark, 1)})

    def slow(read):
        before = sorted(r.k for r in read("a").collect())
        seen.append(before)
        if len(seen) == 1:  # another writer commits in between
            state.transact(spark, root, lambda r: state.Change(append={"a": rows(spark, 2)}))
        return state.Change(replace={"a": rows(spark, *before, 9)})

    assert state.transact(spark, root, slow) == 3 and seen == [[1], [1, 2]]
    assert sorted(r.k for r in state.load(spark, root, "a").collect()) == [1, 2, 9] and state.versions(spark, root) == [1, 2, 3]
    assert [r.k for r in state.load(spark, root, "a", 1).collect()] == [1]

    def beaten(read):
        state.save(spark, root, {"b": rows(spark, 0)})
        return state.Change(replace={"a": rows(spark)})

    with pytest.raises(state.Conflict):
        state.transact(spark, root, beaten, tries=2)
    assert state.load(spark, root, "a").count() == 3


def test_half_written_version_is_none_and_its_number_is_not_used_again(spark, tmp_path):
    root = str(tmp_path / "s")
    state.save(spark, root, {"a": rows(spark, 1)})
    (tmp_path / "s" / "_versions" / "000000000002.json").write_text('{"folders": {"a"')
    assert state.latest(spark, root).number == 1 and state.save(spark, root, {"a": rows(spark, 2)}) == 3
    assert state.versions(spark, root) == [1, 3]


def test_replay_after_a_crash_changes_nothing(spark, tmp_path):
    root, crash = str(tmp_path / "s"), [True]
    step = state.sink(spark, root, "q", lambda batch, read: state.Change(append={"a": batch}))

    def each(batch, number):
        step(batch, number)
        if crash.pop() if crash else False:
            raise RuntimeError("lost after the commit")

    rows(spark, 1, 2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    run = lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost after the commit"):
        run()
    run()
    assert sorted(r.k for r in state.load(spark, root, "a").collect()) == [1, 2] and state.versions(spark, root) == [1]
    assert state.transact(spark, root, lambda read: state.Change(append={"a": rows(spark, 3)}), "other", 0) == 2


def test_schedule_stream_retries_and_marks(spark, tmp_path):
    m = lambda x: T + dt.timedelta(minutes=x)
    schema = "id long, enabled boolean, schedule_type int, next_scrape_at timestamp_ntz, last_scraped_at timestamp_ntz"
    targets = spark.createDataFrame([(1, True, 1, T, None), (2, True, 2, T, None), (3, True, 1, m(300), None), (4, False, 1, T, None), (5, True, 2, T, None)], schema)
    said, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*events):
        spark.createDataFrame(list(events), scheduler.EVENTS).coalesce(1).write.mode("append").parquet(said)
        stream = scheduler.requests(scheduler.events(spark, said), targets)
        stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.what, r["at"]) for r in spark.read.schema(scheduler.SCHEMA).parquet(out).collect())

    first = run((-1, m(5), "clock"))
    assert [(i, w) for i, w, _ in first] == [(1, "due"), (2, "due"), (5, "due")]
    run((1, m(6), "ok"), (2, m(6), "failed"), (99, m(6), "ok"))
    said_now = run((-1, m(8), "clock"))
    assert (2, "retry", m(7)) in said_now and (1, "marked", m(6)) in said_now
    run((2, m(9), "failed"))
    run((-1, m(11), "clock"))
    run((2, m(12), "failed"))  # the third failure: until the next tick
    last = run((-1, m(40), "clock"))
    assert (2, "given up", m(12)) in last and (2, "due", m(27)) in last
    assert sum(w == "due" for i, w, _ in last if i == 5) == 2 and not any(i in (3, 4, 99) for i, _, _ in last)
    done = spark.createDataFrame([(1,)], "id long")
    want = schedule.mark_scraped(targets, done, F.lit(m(6)).cast("timestamp_ntz"))
    got = scheduler.marked(targets, spark.read.schema(scheduler.SCHEMA).parquet(out))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_tick_enriches_by_url_and_keeps_dead_letters(spark, tmp_path):
    root = str(tmp_path / "s")
    item = lambda h, price, stock: {"title": f"AMD Ryzen {h}", "handle": h, "variants": [{"price": price, "available": stock}]}
    page = lambda url, **more: f'<link rel="canonical" href="{url}"><script type="application/ld+json">{json.dumps({"@type": "Product", "name": "AMD Ryzen 5", **more})}</script>'
    lists = json.dumps({"products": [item("a", "10", True), item("b", "20", False), item("a", "12", True)]})
    pages = [(1, 1, lists, False), (2, 1, "gone", False), (3, 1, page("https://X.in/products/a/?q#f", sku="77", description="about"), True), (4, 1, page("https://x.in/products/new", offers={"price": "5"}), True), (5, 1, "no page", True)]
    frame = spark.createDataFrame([(p, s, "https://x.in/", c, k) for p, s, c, k in pages], "page_id long, sid long, base_url string, content string, is_product boolean")
    stores = spark.createDataFrame([(1, "x", "shopify")], "id long, name string, platform string")
    none = spark.createDataFrame([], "sid long, card string, title string, price string, mrp string, image string, url_attr string, image_attr string")
    step = tick.each(root, "t", stores, none, {})
    step(frame, 0)
    step(frame, 0)
    got = {r.pid: r for r in state.load(spark, root, "products").collect()}
    assert set(got) == {"a", "new"} and got["a"].description == "about" and got["a"].url == "https://x.in/products/a" and got["a"].category == "AMD Processor"
    assert got["a"].in_stock is False and float(got["new"].price) == 5  # a page without availability is out of stock
    assert [(r.page_id, r.reason) for r in state.load(spark, root, "dead_letters").collect()] == [(2, "no list of products")]
    assert state.load(spark, root, "history").count() == 1 and state.versions(spark, root) == [1]
    step(frame.filter("page_id = 1"), 1)
    after = {r.pid: r for r in state.load(spark, root, "products").collect()}
    assert after["a"].description == "about" and after["a"].in_stock and state.load(spark, root, "history").count() == 2


def test_cascade_in_order_of_references(spark):
    make = lambda values, schema: spark.createDataFrame(values, schema)
    relations = {
        "shops": make([(1,), (2,)], "id long"), "products": make([(10, 1), (11, 2), (12, None)], "id long, sid long"), "notes": make([(100, 10), (101, 11), (102, None)], "id long, product_id long"),
        "replies": make([(100, 1), (101, 2), (101, None)], "note_id long, sid long"), "other": make([(1,)], "id long"),
    }
    r = maintain.Reference
    references = [r("replies", "note_id", "notes", "id"), r("notes", "product_id", "products", "id"), r("products", "sid", "shops", "id"), r("replies", "sid", "shops", "id")]
    left = {k: sorted(map(tuple, df.collect()), key=str) for k, df in maintain.cascade(relations, references, "shops", F.col("id") == 1).items()}
    assert left == {"shops": [(2,)], "products": [(11, 2), (12, None)], "notes": [(101, 11), (102, None)], "replies": [(101, 2), (101, None)], "other": [(1,)]}
    none = maintain.cascade(relations, references, "shops", F.lit(None).cast("boolean"))
    assert none["replies"].count() == 3 and none["shops"].count() == 2
    one = relations["products"].filter("id = 10")
    assert [x.id for x in maintain.hanging(relations["notes"], references[1], one).collect()] == [101]
    with pytest.raises(ValueError):
        maintain.cascade(relations, [*references, r("shops", "id", "replies", "note_id")], "shops", F.col("id") == 1)


def test_breakdowns_and_slots_by_literal_values(spark):
    items = spark.createDataFrame([(1, 7, Decimal("2.50")), (1, 7, Decimal("1.00")), (1, 8, None), (1, 9, Decimal(3)), (2, 8, Decimal(0))], "build_id long, sid long, price decimal(12,2)")
    stores = spark.createDataFrame([(7, "S", True), (8, "E", True), (9, "off", False)], "id long, display_name string, active boolean")
    got = {r.build_id: [(x.sid, x.display_name, float(x.total), x.n_items) for x in r.breakdown] for r in builder.breakdowns(items, stores).collect()}
    assert got == {1: [(7, "S", 3.5, 2), (8, "E", 0, 0)], 2: [(7, "S", 0, 0), (8, "E", 0, 0)]}
    products = spark.createDataFrame([("CPU",), ("cpu cooler",), (None,), ("SSD",)], "category string")
    assert {r.slot: r.n_products for r in builder.slots(products).collect() if r.n_products} == {"cpu": 2, "storage": 1}


def test_digests_of_builds_are_those_of_whole_breakdowns(spark):
    part = lambda build, sid, price: (build, 1, f"Ryzen {sid}", sid, None if price is None else Decimal(price), "t", "cpu", *[None] * 8)
    rows = [part(1, 3, "2.50"), part(1, 3, "0.55"), part(1, 390, "-7.05"), part(1, 900, "1"), part(2, 5, None), part(2, 6, "0"), part(3, 399, "1234567.89"), part(3, 201, "3"), part(4, 4, "9")]
    specs = "socket string, memory_type string, tdp int, recommended_psu int, wattage int, length_mm int, max_gpu_length_mm int, supported_sockets string"
    items = spark.createDataFrame(rows, f"build_id long, product_id long, name string, sid long, price decimal(12,2), t string, kind string, {specs}")
    stores = spark.createDataFrame([(k, None if k == 8 else f"Shöp number {k}", k != 4) for k in range(400)], "id long, display_name string, active boolean")
    text = F.array_join(F.transform("breakdown", lambda b: F.concat_ws(":", b["sid"].cast("string"), b["display_name"], b["total"].cast("string"), b["n_items"].cast("string"))), ",")
    whole = {r.build_id: (r.d, sum(b.n_items for b in r.breakdown), r.estimated_wattage) for r in builder.summaries(items, stores).withColumn("d", F.md5(text)).collect()}
    df = builder.summary_digests(items.unionByName(items.filter("build_id = 2").withColumn("sid", F.lit(None).cast("long")).withColumn("price", F.lit(5).cast("decimal(12,2)"))), stores)
    got = {r.build_id: (r.breakdown, r.n_priced, r.estimated_wattage) for r in df.collect()}
    assert {k: x[:2] for k, x in got.items()} == {k: x[:2] for k, x in whole.items()} and got[1] == whole[1] and got[4][:2] == (whole[2][0], 0)
    assert builder.summary_digests(items, stores.filter("id < 0")).first().breakdown == "d41d8cd98f00b204e9800998ecf8427e"


def test_answers_about_builds_hold_no_list_of_all_shops(spark):
    plan = queries.validate_answer(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_zip_with" not in plan and plan.count("Join") == 1


class Handle:
    """A group's state and timers in memory, with the number of times that they are written."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)
        self.writes += 1

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_group_of_targets_has_one_state_and_one_timer():
    handle, group, minute = Handle(), scheduler._Targets(), 60_000
    group.init(handle)
    ids = np.arange(5000)[::-1]
    start = pd.DataFrame({"id": ids, "enabled": ids % 5 > 0, "type": 2, "next": (ids % 100 + 1) * minute * 1000, "last": scheduler._NONE})
    for piece in (start[:3000], start[3000:]):
        group.handleInitialState((0,), piece, None)
    assert handle.writes <= 4 and handle.timers == [2 * minute] and list(group._load()["id"]) == list(range(5000))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10 * minute)
    (said,) = group.handleExpiredTimer((0,), now, None)
    assert sorted(said["id"]) == [k for k in range(5000) if k % 5 and k % 100 < 10] and set(said["what"]) == {"due"} and list(said["at"]) == list(said["next"])
    assert handle.timers == [12 * minute]
    rows = pd.DataFrame({"id": [11, 1, 5001, 12], "us": [minute * 11_000] * 4, "kind": ["ok", "failed", "ok", "clock"]})
    (said,) = group.handleInputRows((0,), iter([rows]), now)
    assert {tuple(r) for r in said[["id", "what", "tries"]].values.tolist()} == {(11, "marked", 0), (1, "failed", 1)} and handle.timers == [12 * minute] and handle.writes <= 8


def test_a_batch_in_slices_of_shops_leaves_the_same_state(spark, tmp_path, monkeypatch):
    lists = [(s, s, "https://x.in/", json.dumps({"products": [{"title": f"AMD Ryzen {h}", "handle": h, "variants": [{"price": "10", "available": h != "b"}]} for h in "abc"]}), False) for s in range(7)]
    page = '<link rel="canonical" href="https://X.in/products/{}/?q"><script type="application/ld+json">{{"@type": "Product", "name": "N", "sku": "k{}", "description": "about"}}</script>'
    pages = [(100 + s, s, "https://x.in/", page.format("abz"[s % 3], s), True) for s in range(7)] + [(200, 3, "https://x.in/", "gone", False), (201, 4, "https://x.in/", None, False)]
    schema = "page_id long, sid long, base_url string, content string, is_product boolean"
    stores = spark.createDataFrame([(s, f"x{s}", "shopify") for s in range(7)], "id long, name string, platform string")
    none = spark.createDataFrame([], "sid long, card string, title string, price string, mrp string, image string, url_attr string, image_attr string")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, left = set(shared.glob("parsed-pages-*")), []
    for n in (1, 3):
        monkeypatch.setattr(tick, "slices", lambda pages, n=n: n)
        root = str(tmp_path / str(n))
        step = tick.each(root, "t", stores, none, {})
        for turn, rows_ in enumerate((lists, pages)):
            step(spark.createDataFrame(rows_, schema), turn)
        left.append({k: sorted(map(str, state.load(spark, root, k).collect())) for k in ("products", "history", "dead_letters")})
        assert len(state.latest(spark, root).folders["products"]) == n and state.versions(spark, root) == [1, 2]
    assert left[0] == left[1] and len(left[0]["products"]) > 14 and len(left[0]["dead_letters"]) == 2
    assert set(shared.glob("parsed-pages-*")) == before  # what a batch alone reads is deleted once its version is written
    monkeypatch.undo()
    monkeypatch.setattr(tick, "SLICE", 100)
    spark.createDataFrame(lists, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, n: seen.append(tick.slices(df)))
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [tick.SLICES] and tick.slices(stores) == 1
