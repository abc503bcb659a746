"""Domain relations over the star-schema tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TITLES = [
    "AMD Ryzen 7 7800X3D 8-Core Desktop Processor AM5 120W", "Intel Core i5-14400F 10 cores 16 threads 4.70 GHz LGA1700", "Intel Core Ultra 7 265K LGA1851 Processor 20 cores",
    "MSI Gaming GeForce RTX 5080 16G GDDR7", "Zotac GeForce RTX 5070 Ti 16GB", "Sapphire Radeon RX 7800 XT 16GB", "ASUS TUF B650 Micro ATX AM5 Motherboard DDR5",
    "Gigabyte Z790 LGA1700 DDR4 ATX Motherboard", "MSI B550 AM4 mini ITX Motherboard", "Corsair Vengeance 32GB DDR5 6000 MHz Memory", "Kingston Fury 16 GB DDR4 3200MHz Laptop SO-DIMM",
    "Samsung 990 Pro 2 TB NVMe Gen4 SSD", "Crucial BX500 480GB SATA SSD", "Seagate External Portable HDD 4TB", "NZXT Kraken 360mm AIO Liquid Cooler", "Deepcool AK620 Air Cooler",
    "Corsair RM850e 850W 80+ Gold Power Supply", "Antec 550 W Bronze PSU", "Lian Li Full Tower Cabinet", "Cooler Master matx case", "LG 27 inch 144 hz QHD Monitor", "Samsung 32 inch 4K 60hz Curved Display",
    "Keychron K2 Mechanical Keyboard", "Logitech MX Master Wireless Mouse",
    "Intel Core i7-13700 13th gen 65 W", "AMD Threadripper 7960X 24 core 48 thread", "Ryzen 5600 AM4 Processor", "Intel Core i3 12th CPU", "Palit 5090 card 32GB", "GeForce RTX 5090 GDDR7 575W", "RTX 5060 Ti 8 GB", "RTX 5060ti",
    "RTX 4090 GPU", "GTX 1650 graphics card", "RTX 3060 12GB", "ASRock X870 EATX mobo", "Gigabyte Z890 AORUS E-ATX Motherboard", "MSI H610 M-ATX", "ASUS B760 mATX LGA 1700", "X570 Mini-ITX AM4",
    "8GB RAM 2666 mhz", "Crucial 16GB SODIMM", "Gen5 NVMe 1TB", "Gen3 M.2 512 gb", "WD Elements external SSD 1 TB", "Solid state disk", "Toshiba hard drive 2TB", "Portable hard disk HDD 5 TB",
    "240mm radiator", "Arctic 420 cooling fan", "Thermal paste", "Case fan 120 mm", "EVGA 1000W 80+ Platinum", "SMPS 450 watt", "80 Plus Gold 650w unit", "Super Tower chassis", "Mini-ITX tower", "Micro-ATX cabinet white",
    "Dell 24\" FHD screen", "BenQ 1920x1080 75Hz", "Acer 2560x1440 curved 27-inch", "LG 3840x2160 display", "Mouse pad XL", "Headset HyperX", "Logitech webcam C920", "Cable USB", "Gaming mouse", "Office keyboard",
]
#: What titles end in; near misses of words that rules look for.
ENDINGS = ["", " F", " f", " (no graphics)", " 5070", " eatx", " ddr4", " 2k", " 95w", " 14th", " fan", " 3.60 GHz"]
SPECIFICATIONS = [None, "{}", '{"socket": "AM5"}', '{"memory": "DDR4 3200 MHz"}', '{"Chipset": "RTX 5070 Ti"}', '{"Cores": "12-core", "TDP": "105 W"}']
CATEGORIES = [None, "", "Monitor", "Gaming keyboard", "Processor"]
SEGMENTS = ["", "gen4-ssd/", "Desktop-RAM/", "offers/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def title_of(pid: Column) -> Column:
    return F.concat(_element(TITLES, pid), _element(ENDINGS, F.floor(pid / len(TITLES))))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda head: F.concat(F.lit(head), "s_name")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), text("Shop ").alias("display_name"), F.lit("s.example").alias("domain"), text("https://s.example/").alias("base_url"),
        F.concat(text("https://s.example/"), F.lit("/search?q={query}")).alias("search_endpoint"), F.lit("INR").alias("currency"), F.lit("₹").alias("currency_symbol"), (F.col("s_acctbal") >= 0).alias("active"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each time that a shop's offer was seen; null and zero prices and unknown stock occur."""
    price = F.when(F.col("l_orderkey") % 97 == 0, None).when(F.col("l_orderkey") % 101 == 0, 0).otherwise(F.col("l_extendedprice")).cast("decimal(12,2)")
    stock = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("pid"), (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("product_id"),
        F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").alias("page"), price.alias("price"),
        F.when(F.col("l_orderkey") % 7 != 0, price + F.col("l_quantity").cast("int")).cast("decimal(12,2)").alias("mrp"),
        stock.alias("in_stock"), F.col("l_shipdate").alias("scraped_at"), F.col("l_quantity").alias("tie"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation of each product; one aggregate with map-side combine, no window."""
    order = F.struct("scraped_at", "target_id", "page", "tie", F.coalesce("price", F.lit(-1)).alias("p"))
    last = F.max_by(F.struct("sid", "pid", "price", "mrp", "in_stock", "scraped_at"), order)
    rows = observations(spark, sf_dir).groupBy("product_id").agg(last.alias("x")).select(F.col("product_id").alias("id"), "x.*")
    pid = F.col("pid")
    made = {
        "name": title_of(pid),
        "product_url": F.concat(F.lit("https://s.example/product/"), _element(SEGMENTS, pid), F.lit("item-"), pid.cast("string"), F.when(pid % 3 == 0, "/?v=1").otherwise("")),
        "category": _element(CATEGORIES, F.floor(pid / 3)), "specifications": _element(SPECIFICATIONS, F.floor(pid / 7)), "description": F.when(pid % 5 > 0, F.concat(F.lit("About "), pid.cast("string"))),
    }
    return rows.withColumns(made).withColumnsRenamed({"price": "current_price", "mrp": "current_mrp", "scraped_at": "updated_at"})


def scrape_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10 + 1).alias("store_id"), (F.col("o_orderstatus") != "F").alias("enabled"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderkey") % 3).cast("int").alias("schedule_type"),
        F.col("o_orderdate").alias("next_scrape_at"), F.concat(F.lit("keyword "), (F.col("o_custkey") % 50).cast("string")).alias("target_value"),
        F.get(F.array(*map(F.lit, ["GPU", "CPU", "Monitor"])), (F.col("o_custkey") % 4).cast("int")).alias("category"),
        (F.col("o_orderkey") % 4).cast("int").alias("target_type"), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderdate") - F.expr("interval 36 hour")).alias("last_scraped_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"max_pages": '), (F.col("o_orderkey") % 4).cast("string"), F.lit(', "category": "GPU"}'))).alias("schedule_config"),
    )


def product_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("product_id", "target_id").distinct()


def _list_sql(values: list) -> str:
    return "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in values) + "]"


#: The same relations as common table expressions.
SQL = f"""
stores AS (SELECT s_suppkey AS id, s_name AS name, 'Shop ' || s_name AS display_name, 's.example' AS domain, 'https://s.example/' || s_name AS base_url, 'https://s.example/' || s_name || '/search?q={{query}}' AS search_endpoint,
  'INR' AS currency, '₹' AS currency_symbol, s_acctbal >= 0 AS active FROM supplier),
obs0 AS (
  SELECT *, (CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 0 ELSE l_extendedprice END)::DECIMAL(12,2) AS price FROM lineitem),
observations AS (
  SELECT l_suppkey AS sid, l_partkey AS pid, l_suppkey * 10000000 + l_partkey AS product_id, l_orderkey AS target_id, l_linenumber AS page, price,
    CASE WHEN l_orderkey % 7 <> 0 THEN (price + l_quantity::INT)::DECIMAL(12,2) END AS mrp,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS in_stock, l_shipdate AS scraped_at, l_quantity AS tie FROM obs0),
products AS (
  SELECT product_id AS id, sid, pid, price AS current_price, mrp AS current_mrp, in_stock, scraped_at AS updated_at,
    ({_list_sql(TITLES)})[pid % {len(TITLES)} + 1] || ({_list_sql(ENDINGS)})[pid // {len(TITLES)} % {len(ENDINGS)} + 1] AS name,
    'https://s.example/product/' || ({_list_sql(SEGMENTS)})[pid % {len(SEGMENTS)} + 1] || 'item-' || pid || CASE WHEN pid % 3 = 0 THEN '/?v=1' ELSE '' END AS product_url,
    ({_list_sql(CATEGORIES)})[pid // 3 % {len(CATEGORIES)} + 1] AS category, ({_list_sql(SPECIFICATIONS)})[pid // 7 % {len(SPECIFICATIONS)} + 1] AS specifications,
    CASE WHEN pid % 5 > 0 THEN 'About ' || pid END AS description
  FROM observations QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, target_id DESC, page DESC, tie DESC, coalesce(price, -1) DESC) = 1),
scrape_targets AS (
  SELECT o_orderkey AS id, o_custkey % 10 + 1 AS store_id, o_orderstatus <> 'F' AS enabled, substr(o_orderpriority, 1, 1)::INT AS priority, (o_orderkey % 3)::INT AS schedule_type,
    o_orderdate AS next_scrape_at, 'keyword ' || (o_custkey % 50) AS target_value, (['GPU', 'CPU', 'Monitor', NULL])[o_custkey % 4 + 1] AS category, (o_orderkey % 4)::INT AS target_type,
    CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate - INTERVAL 36 HOUR END AS last_scraped_at,
    CASE WHEN o_orderkey % 3 = 0 THEN '{{"max_pages": ' || (o_orderkey % 4) || ', "category": "GPU"}}' END AS schedule_config FROM orders),
product_targets AS (SELECT DISTINCT product_id, target_id FROM observations)
"""
