"""Product cards, product pages, dispatch and dump tables on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from offerlake.sources import cards, dump, markup, product

PAGE = "page_id long, sid long, base_url string, content string"


def pages(spark, *contents, sid=7):
    return spark.createDataFrame([(k, sid, "https://s.in/shop/", c) for k, c in enumerate(contents)], PAGE)


CARDS = """<ul id="list"><li class="card big"><h3 class="t"><a href="/product/ram/kit-a/?v=1">Kit &amp; A</a></h3>
<span class="old price">₹2,000</span><span class="price now">₹1,500.50</span><b class="mrp">2,000</b><img class="i" src="data:x" data-src="//cdn/a.png"></li>
<li class="card"><a class="t" href="item-b">Kit B</a><span class="price">N/A</span><p>SOLD OUT</p></li>
<li class="card"><h3 class="t">no price</h3></li><li class="other"><h3 class="t">x</h3><span class="price">5</span></li></ul>"""


def selectors(spark, sid=7):
    return spark.createDataFrame([(sid, "#list > li.card", "h3.t, a.t", "span[class*='price']", ".mrp", "li img.i", None, None)], "sid long, card string, title string, price string, mrp string, image string, url_attr string, image_attr string")


def test_cards_by_selectors(spark):
    a, b = sorted(cards.by_selectors(pages(spark, CARDS, None, "", "<li"), selectors(spark)).collect(), key=lambda r: r.name)
    assert (a.pid, a.name, a.url, a.image) == ("kit-a", "Kit & A", "https://s.in/product/ram/kit-a/?v=1", "https://cdn/a.png")
    assert (float(a.price), float(a.mrp), a.in_stock) == (1500.5, 2000, True)
    assert (b.pid, b.url, float(b.price), b.mrp, b.in_stock) == ("item-b", "https://s.in/shop/item-b", 0, None, False)
    assert cards.by_selectors(pages(spark, CARDS), selectors(spark, 8)).count() == 0


@pytest.mark.parametrize("css, found", [("li", 4), (".card", 3), ("li.card.big", 1), ("#list > li", 4), ("body > li", 0), ("ul span", 4), ("ul > span", 0), ("a, h3", 5), ("a[href*='product']", 1), ("[data-src]", 1), ("", 0)])
def test_selectors(css, found):
    which = markup.index((css,))
    assert sum(bool(which.found(e)) for e in markup.elements(CARDS, [])) == found


def test_joined_urls(spark):
    links = {"../a/b": "https://s.in/a/b", "./c?x=../y": "https://s.in/shop/c?x=../y", "d/../e/": "https://s.in/shop/e/", "../../../f": "https://s.in/f", "/g": "https://s.in/g", "//cdn/h": "https://cdn/h", "https://o.in/i": "https://o.in/i", "j": "https://s.in/shop/j"}
    got = spark.createDataFrame(list(links.items()), "l string, want string").select("l", "want", cards.joined_url(F.lit("https://s.in/shop/"), F.col("l")).alias("u")).collect()
    assert {r.l: r.u for r in got} == links


def test_cards_by_text(spark):
    card = "<div><p>{0}</p><h2><a href='/product/x/{1}/'>{2}</a></h2></div>"
    html = "".join(card.format(*c) for c in [
        ("₹ 1,200 450 ₹1,500 In Stock", "a", "A"), ("12,000 9,000 Low Stock", "b", "B"), ("1,000 Out of Stock In Stock", "c", "C"),
        ("300 In Stock", "d", "D"), ("2,000 In Stock", "e", "View Product"), ("1,700 In Stock", "a", "A again"),
    ])
    got = {r.pid: (r.name, float(r.price), float(r.mrp)) for r in cards.by_text(pages(spark, html, None)).collect()}
    assert got == {"a": ("A", 1200, 1500), "b": ("B", 12000, 12000)}


def test_product_pages(spark):
    shop = {"product": {"title": "T", "handle": "t", "vendor": None, "body_html": "<p>", "variants": [{"price": "5", "compare_at_price": None, "available": True, "sku": "k"}], "images": [{"src": "i"}]}}
    (r,) = product.shopify_product(pages(spark, json.dumps(shop), "no", None)).collect()
    assert (r.pid, float(r.price), float(r.mrp), r.in_stock, r.image, r.specs) == ("t", 5, 5, True, "i", {"sku": "k"})
    ld = '<link href="https://s.in/p/nine/" rel="canonical"><script type="application/ld+json">[{"@type":"Thing"},{"@type":"Product","name":"N","image":["i1","i2"],"brand":"B","mpn":"m","gtin13":"","offers":{"price":"7"}}]</script>'
    graph = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"N"}]}</script>'
    (r,) = product.product_page(pages(spark, ld, graph, None)).collect()
    assert (r.pid, r.url, r.image, r.brand, float(r.price), r.mrp, r.in_stock, r.specs) == ("nine", "https://s.in/p/nine/", "i1", "B", 7, None, False, {"mpn": "m"})


def test_dispatch(spark):
    shop = json.dumps({"products": [{"title": "A", "handle": "a", "variants": [{"price": "10", "available": True}]}]})
    text = "<div><p>1,200 In Stock</p><h2><a href='/product/b/'>B</a></h2></div>"
    stores = spark.createDataFrame([(1, "x", "shopify"), (2, "y", None), (3, "z", "shopify")], "id long, name string, platform string")
    rows = pages(spark, shop, sid=1).unionByName(pages(spark, CARDS, sid=2)).unionByName(pages(spark, text, sid=3)).unionByName(pages(spark, shop, sid=4))
    got = product.parse_lists(rows, stores, selectors(spark, 2), {"z": "text"}).collect()
    assert sorted((r.sid, r.pid) for r in got) == [(1, "a"), (2, "item-b"), (2, "kit-a"), (3, "b")]


def test_dump(spark, tmp_path):
    lines = ["SET x = 1;", "COPY public.stores (id, name, config) FROM stdin;", "1\tA\\tB\t{\"a\": \"x\\\\ny\"}", "2\t\\N\t", "\\.", "COPY public.other (id) FROM stdin;", "3", "\\."]
    path = tmp_path / "dump.sql"
    path.write_text("\n".join(lines))
    got = dump.dump_table(spark, str(path), "stores")
    assert got.columns == ["id", "name", "config"]
    assert sorted(map(tuple, got.collect())) == [("1", "A\tB", '{"a": "x\\ny"}'), ("2", None, "")]
    with pytest.raises(ValueError):
        dump.dump_table(spark, str(path), "store")


def random_page(rnd):
    """A page of nested elements with classes, ids and texts, and what a plain tree of it holds."""
    tags, classes = ["div", "p", "a", "b", "li"], ["card", "t", "price", "x"]
    root = {"tag": "", "cls": "", "id": None, "parts": [], "up": None}

    def grow(node, depth):
        for _ in range(rnd.randrange(4)):
            if depth > 4 or rnd.random() < 0.4:
                if node["parts"] and isinstance(node["parts"][-1], str):
                    continue  # texts side by side are one
                node["parts"].append(rnd.choice(["one ", "₹1,200", " & ", "Out of Stock", "two\n"]))
            else:
                child = {"tag": rnd.choice(tags), "cls": rnd.choice(classes), "id": rnd.choice(["i", None]), "parts": [], "up": node}
                node["parts"].append(child)
                grow(child, depth + 1)

    for _ in range(3):
        grow(root, 0)
    return root


def written(part):
    if isinstance(part, str):
        return part.replace("&", "&amp;")
    name = f' id="{part["id"]}"' if part["id"] else ""
    inner = "".join(map(written, part["parts"]))
    return f"<{part['tag']} class='{part['cls']} y'{name}>{inner}</{part['tag']}>" if part["tag"] else inner


def below(node):
    for part in node["parts"]:
        yield part
        if not isinstance(part, str):
            yield from below(part)


def chained(node, steps):
    """Descendant steps (tag or class), the last of which the node is."""
    if not node["tag"] or not (node["tag"] == steps[-1] or "." + node["cls"] == steps[-1]):
        return False
    up, rest = node["up"], steps[:-1]
    while rest and up is not None:
        if chained(up, rest):
            return True
        up = up["up"]
    return not rest


@pytest.mark.parametrize("seed", range(40))
def test_cards_equal_a_plain_tree(seed):
    rnd = random.Random(seed)
    root = random_page(rnd)
    s = {"card": "div.card, li", "title": ".t, a", "price": "div .price", "mrp": "b", "image": "img", "url_attr": None, "image_attr": None}
    text = lambda n: " ".join(" ".join(p for p in below(n) if isinstance(p, str)).split())
    nodes = [n for n in below(root) if not isinstance(n, str)]
    want = []
    for card in (n for n in nodes if n["tag"] == "li" or (n["tag"] == "div" and n["cls"] == "card")):
        inside = [n for n in below(card) if not isinstance(n, str)]
        titles = [n for n in inside if n["cls"] == "t" or n["tag"] == "a"]
        prices, mrps = [n for n in inside if chained(n, ["div", ".price"])], [n for n in inside if n["tag"] == "b"]
        if titles and prices:
            name = "".join(p.strip() for p in below(titles[0]) if isinstance(p, str))
            want.append((name, text(prices[-1]), text(mrps[0]) if mrps else None, text(card)))
    assert [(c[0], c[3], c[4], c[5]) for c in markup.cards(written(root), s)] == want


def test_loose_markup():
    s = {"card": ".c", "title": "h3", "price": "b", "mrp": "", "image": "img", "url_attr": None, "image_attr": "src"}
    html = "<!doctype html><!-- <div class=c> --><script>'<div class=\"c\">'</script><div class=c><h3>A <a HREF='x?a=1&amp;b=2'>B</a></h3></p><br/><img src=i.png><b>5 < 6<style>b{}</style>"
    assert list(markup.cards(html, s)) == [("AB", "x?a=1&b=2", "i.png", "5 < 6", None, "A B 5 < 6")]
    hard = "<a " * 20_000 + '<a "' * 20_000 + "<" * 20_000
    assert list(markup.cards(hard, s)) == [] and list(markup.cards(None, s)) == []


def test_dead_letters(spark):
    shop = json.dumps({"products": []})
    stores = spark.createDataFrame([(1, "x", "shopify"), (2, "y", None), (3, "n", None)], "id long, name string, platform string")
    rows = pages(spark, shop, "gone", None, sid=1).unionByName(pages(spark, CARDS, sid=2)).unionByName(pages(spark, "<p>", sid=3))
    found = product.parsed(rows, stores, selectors(spark, 9), {"n": "next"})
    assert sorted((r.sid, r.page_id, r.reason) for r in product.dead_letters(found).collect()) == [(1, 1, "no list of products"), (1, 2, "no content"), (2, 0, "no selectors"), (3, 0, "no product data")]
    assert product.offers(found).count() == 0


def test_dump_in_many_ranges_equals_one(spark, tmp_path):
    rnd = random.Random(3)
    text = ["SET a;", "COPY public.t (id, v) FROM stdin;"] + [f"{k}\t{'é' * rnd.randrange(30)}\\t{k}" for k in range(300)] + ["\\.", "COPY public.u (id) FROM stdin;", "5", "\\.", "", "COPY t2 (id) FROM stdin;", "9"]
    (tmp_path / "d.sql").write_bytes("\n".join(text).encode())
    want = [(str(k), line.split("\t")[1].replace("\\t", "\t")) for k, line in enumerate(text[2:302])]
    for split in (1, 7, 100, 1 << 20):
        if split == 1:
            got = list(map(tuple, dump.dump_table(spark, str(tmp_path / "d.sql"), "t2", 50).collect()))
            assert got == [("9",)]  # no end mark, no end of the line
            continue
        rows = dump.dump_table(spark, str(tmp_path / "d.sql"), "t", 40 if split == 7 else split, "place").orderBy("place").collect()
        assert [(r.id, r.v) for r in rows] == want
    assert [r.id for r in dump.dump_table(spark, f"file://{tmp_path}/d.sql", "u").collect()] == ["5"]


def test_lines_of_every_range_by_brute_force(tmp_path):
    data = b"a\n\nbb\r\n\nccc\n" + b"x" * 50 + b"\nlast"
    (tmp_path / "f").write_bytes(data)
    system, path = dump._opened(str(tmp_path / "f"))
    whole = list(dump._lines(system, dump.Range(0, path, 0, len(data))))
    assert [x for _, x in whole] == [b"a", b"", b"bb", b"", b"ccc", b"x" * 50, b"last"]
    for split in range(1, len(data) + 1):
        parts = [x for at in range(0, len(data), split) for x in dump._lines(system, dump.Range(0, path, at, min(at + split, len(data))))]
        assert parts == whole


SITES = """
good:
  name: "Good Shop"
  base_url: "https://g.in"
  currency: "INR"
  search_config: {selectors: {product_card: .c, title: h3, price: .p, mrp: .m, image: img}, attributes: {url: href, image: src}}
json:
  name: Json Shop
  enabled: false
  search_config: {platform: shopify, page_endpoint: "/products.json"}
bare:
  search_config: {platform: fleetcart}
short:
  selectors: {title: h3, price: .p, mrp: .m, image: img}
  attributes: {url: href}
empty:
"""


def test_shops_of_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(SITES)
    (tmp_path / "b.yaml").write_text("more:\n  platform: nextjs\n  page_endpoint: /x\n")
    (tmp_path / "c.yaml").write_text("")
    got = {r.name: r for r in dump.shops(spark, str(tmp_path)).collect()}
    assert set(got) == {"good", "json", "bare", "short", "empty", "more"} and not got["json"].active and got["good"].active
    assert got["good"].selectors["product_card"] == ".c" and got["json"].page_endpoint == "/products.json" and got["empty"].display_name is None
    faults = {(r.name, r.missing) for r in dump.faults(dump.shops(spark, str(tmp_path))).collect()}
    assert {f for f in faults if f[0] != "empty"} == {("bare", "page_endpoint"), ("short", "selectors.product_card"), ("short", "attributes.image")}
    assert sum(n == "empty" for n, _ in faults) == 7
    stores = spark.createDataFrame([(7, "good"), (8, "json")], "id long, name string")
    asked = dump.page_selectors(dump.shops(spark, str(tmp_path)), stores)
    html = '<div class="c"><h3><a href="/product/k">K</a></h3><b class="p">5</b></div>'
    (r,) = cards.by_selectors(pages(spark, html), asked).collect()
    assert (r.name, r.pid, float(r.price)) == ("K", "k", 5)


def test_a_task_takes_as_many_ranges_as_make_up_its_share(tmp_path):
    rnd = random.Random(3)
    for k in range(3):
        (tmp_path / f"f{k}").write_bytes(b"".join(rnd.choice([b"COPY t (a) FROM stdin;\n", b"one\r\n", b"\n", "zwölf".encode(), b"\\.\n", b"\xe2\x82"]) for _ in range(3000)))
    whole, small = (dump._DumpReader({"path": str(tmp_path), "split": split}) for split in (1 << 20, 7))
    shares = small.partitions()
    assert len(whole.partitions()) == 1 and 30 < len(shares) < 40 and sum(len(s.ranges) for s in shares) > 3000
    read = lambda reader, shares: [tuple(r.values()) for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert read(small, shares) == read(whole, whole.partitions())
    marks = dump._DumpReader({"path": str(tmp_path), "split": 7, "marks": "true"})
    assert read(marks, shares) == [r for r in read(small, shares) if r[2] == "\\." or r[2].startswith("COPY ")]


def test_pages_of_one_shape_are_read_alike():
    css = {"card": "div.card", "title": "h3", "price": "b[class*='price']", "mrp": "s", "image": "img", "url_attr": None, "image_attr": None}
    page = '<DIV class=card><h3><a href="/p/{0}?a&amp;b" data-n="{0}">A {0} &amp; b</a></h3><b class="{1}">{2}</b><s data-x="{3}"/>{3}<img data-src="i{0}"></div><div class=card><h3> t</h3><b class=price>1</b><p>{4}'
    rows = [(k, ("price", "cost", "now price")[k % 3], k * 2, k, ("", "<br>", "tail")[k % 3]) for k in range(60)]
    want = [[(f"A {k} & b", f"/p/{k}?a&b", f"i{k}", str(p), "", f"A {k} & b {p} {q}")] * ("price" in c) + [("t", "", "", "1", None, "t 1 tail" if "tail" in t else "t 1")] for k, c, p, q, t in rows]
    assert [list(markup.cards(page.format(*r), css)) for r in rows] == want
    # Long pages and those with scripts are read as a stream; so are these, once more.
    assert [list(markup.cards("<script>'<div class=card>'</script>" + page.format(*r), css)) for r in rows] == want
    which = markup.index(("div.card", "h3", "b[class*='price']", "s", "img", "a"))
    assert len(which.shapes) == 3 and len(which.known) < 40  # a shape for each class and end
