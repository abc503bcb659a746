"""Scalar helpers over columns: prices, slugs and urls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Path segments that name a category rather than a product.
CATEGORY_SLUGS = (
    "processor", "cpu-cooler", "motherboard", "graphics-card", "desktop-ram", "internal-hdd", "sata-ssd", "gen3-ssd", "gen4-ssd", "gen5-ssd",
    "monitor", "cabinet", "smps", "external-hdd", "external-ssd", "laptop-ram", "ram", "storage", "hard-drive",
)
#: Parts of a listing's path that say that its pages are path segments.
PATH_PAGES = ("buy-online-price-india", "product-category", "/page/")


def clean_price(text: Column) -> Column:
    """A price text as decimal; 0 where it is none."""
    return F.coalesce(F.trim(F.translate(text, "₹,", "")).try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))


def slug(url: Column, name: Column, category_slugs: tuple[str, ...] = CATEGORY_SLUGS) -> Column:
    """Product id of a url: the segment after /product/ that is no category, else the last segment, else the name with hyphens for spaces."""
    path = F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"))
    last = F.element_at(F.split(path, "/"), -1)
    after = F.filter(F.split(F.split_part(path, F.lit("/product/"), F.lit(2)), "/"), lambda x: x != "")
    first, end = F.get(after, F.lit(0)), F.element_at(after, -1)
    chosen = F.when(F.size(after) == 0, last).when(F.lower(first).isin(*category_slugs) & (F.size(after) > 1), end).otherwise(first)
    by_name = F.replace(F.lower(name), F.lit(" "), F.lit("-"))
    return F.when(F.coalesce(url, F.lit("")) == "", by_name).when(F.contains(path, F.lit("/product/")), chosen).otherwise(last)


def search_url(template: Column, query: Column, page: Column, later: Column | None = None) -> Column:
    """A search url: {query} form-encoded, {page} as number; pages after the first by the template later, if there is one."""
    chosen = template if later is None else F.when((page > 1) & later.isNotNull(), later).otherwise(template)
    return F.replace(F.replace(chosen, F.lit("{query}"), F.url_encode(query)), F.lit("{page}"), page.cast("string"))


def _under(base: Column, endpoint: Column) -> Column:
    return F.when(endpoint.startswith("http"), endpoint).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(endpoint, F.lit("/"))))


def category_url(dialect: Column, base: Column, endpoint: Column, page: Column) -> Column:
    """Page n of a category listing: shopify, fleetcart, htmx and next by the shop's dialect, else path or query pages by the endpoint."""
    n, url = page.cast("string"), _under(base, endpoint)
    asks = F.contains(url, F.lit("?"))
    more = lambda text: F.when(asks, F.concat(url, F.lit("&" + text), n)).otherwise(F.concat(url, F.lit("?" + text), n))
    json = F.when(F.contains(endpoint, F.lit("products.json")), F.when(page > 1, more("page=")).otherwise(url)).otherwise(
        F.concat(url, F.lit("/products.json?limit=250"), F.when(page > 1, F.concat(F.lit("&page="), n)).otherwise(""))
    )
    last = F.element_at(F.split(F.trim(endpoint, F.lit("/")), "/"), -1)
    stocked = F.when(asks, F.when(page > 1, F.concat(url, F.lit("&page="), n)).otherwise(url)).otherwise(F.concat(url, F.lit("?in_stock=true"), F.when(page > 1, F.concat(F.lit("&page="), n)).otherwise("")))
    by_path = F.lit(False)
    for part in PATH_PAGES:
        by_path = by_path | F.contains(url, F.lit(part))
    head, tail = F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/")), F.when(asks, F.concat(F.lit("?"), F.substring_index(url, "?", -1))).otherwise("")
    paged = F.when(by_path, F.concat(head, F.lit("/page/"), n, F.lit("/"), tail)).otherwise(more("page="))
    return (
        F.when(dialect == "shopify", F.when(endpoint.startswith("http"), endpoint).otherwise(json))
        .when(dialect == "fleetcart", F.concat(F.rtrim(base, F.lit("/")), F.lit("/products?category="), last, F.lit("&page="), n))
        .when(dialect == "htmx", F.when(page == 1, url).otherwise(F.concat(more("page="), F.lit("&sort=newest"))))
        .when(dialect == "next", stocked)
        .otherwise(F.when(page == 1, url).otherwise(paged))
    )


def product_url(base: Column, path: Column, platform: Column) -> Column:
    """Absolute product url; shopify products without a query are read as JSON."""
    full = _under(base, path)
    return F.when((platform == "shopify") & ~F.contains(full, F.lit("?")) & ~full.endswith(".json"), F.concat(F.rtrim(full, F.lit("/")), F.lit(".json"))).otherwise(full)
