"""SQL twins of the rules, written by hand from the wording of the rules and not from their tables.

x has id, name, t (title and specifications, lower-cased), f (title, raw category and url, lower-cased) and c (a present category).
"""

X = """, x AS (SELECT id, name, lower(name || ' ' || coalesce(specifications, '{}')) AS t, lower(name || ' ' || coalesce(category, '') || ' ' || coalesce(product_url, '')) AS f, lower(name) AS n, 'Accessories' AS c FROM products)"""

CATEGORY = r"""CASE
WHEN regexp_matches(f, '\b(rtx\s?\d{4}|rx\s?\d{4}|graphics card|vga|gpu|geforce|radeon)\b') THEN 'GPU'
WHEN regexp_matches(f, '\b(ryzen\s?\d{4}|intel core|processor|cpu|i[3579]-|core ultra)\b') THEN 'CPU'
WHEN regexp_matches(f, '\b(aio|(liquid|cpu|air) cooler|radiator|(24|36|42)0mm|hyper 212|ak620|frozen prism)\b') THEN 'CPU Cooler'
WHEN regexp_matches(f, '\b(cabinet|case|chassis|(mid|full) tower)\b') THEN 'Cabinet'
WHEN regexp_matches(f, '\b(monitor|display|1440p|ips panel|hz)\b') THEN 'Monitor'
WHEN regexp_matches(f, '\b(keyboard|keychron)\b') THEN 'Keyboard'
WHEN regexp_matches(f, '\b(mouse|mx master)\b') THEN 'Mouse' ELSE 'Accessories' END"""

TITLE = r"""CASE
WHEN regexp_matches(n, 'ryzen|intel core|i[3579]-|ultra [579]|threadripper|processor') AND NOT regexp_matches(n, 'cooler|fan|motherboard') THEN
  CASE WHEN n LIKE '%threadripper%' THEN 'Threadripper Processor' WHEN regexp_matches(n, 'intel|i[3579]-|ultra') THEN 'Intel Processor' WHEN regexp_matches(n, 'ryzen|amd') THEN 'AMD Processor' ELSE 'Processor' END
WHEN regexp_matches(n, 'motherboard|mobo|b[456]50|x[56]70|h610|b760|z[78]90') THEN
  CASE WHEN regexp_matches(n, 'intel|h610|b760|z[78]90|lga') THEN 'Intel Motherboard' WHEN regexp_matches(n, 'amd|b[456]50|x[56]70|am[45]') THEN 'AMD Motherboard' ELSE 'Motherboard' END
WHEN regexp_matches(n, 'geforce|radeon|graphics card|rtx|gtx|rx |gpu') THEN
  CASE WHEN n LIKE '%rtx 50%' THEN 'NVIDIA RTX 50 Series' WHEN n LIKE '%rtx 40%' THEN 'NVIDIA RTX 40 Series' WHEN n LIKE '%rtx 30%' THEN 'NVIDIA RTX 30 Series'
    WHEN regexp_matches(n, 'radeon|rx ') THEN 'AMD Graphics Card' WHEN regexp_matches(n, 'geforce|nvidia|rtx|gtx') THEN 'Graphics Card (NVIDIA)' ELSE 'Graphics Card' END
WHEN regexp_matches(n, 'ddr[45]|ram|memory') THEN
  (CASE WHEN regexp_matches(n, 'laptop|so-?dimm') THEN 'Laptop RAM' ELSE 'Desktop RAM' END) || (CASE WHEN n LIKE '%ddr5%' THEN ' (DDR5)' WHEN n LIKE '%ddr4%' THEN ' (DDR4)' ELSE '' END)
WHEN regexp_matches(n, 'nvme|ssd|m\.2|hard drive|hdd|solid state') THEN
  CASE WHEN regexp_matches(n, 'hdd|hard drive|hard disk') THEN CASE WHEN regexp_matches(n, 'external|portable') THEN 'External HDD' ELSE 'Internal HDD' END
    WHEN regexp_matches(n, 'external|portable') THEN 'External SSD' WHEN n LIKE '%gen5%' THEN 'Gen5 NVMe SSD' WHEN n LIKE '%gen4%' THEN 'Gen4 NVMe SSD'
    WHEN regexp_matches(n, 'm\.2|nvme') THEN 'M.2 NVMe SSD' WHEN n LIKE '%sata%' THEN '2.5" SATA SSD' ELSE 'SSD' END
WHEN regexp_matches(n, 'cooler|cooling|aio|fan|thermal paste') THEN CASE WHEN regexp_matches(n, 'liquid|aio') THEN 'CPU Liquid Cooler' WHEN n LIKE '%air%' THEN 'CPU Air Cooler' ELSE 'CPU Cooler' END
WHEN regexp_matches(n, 'power supply|psu|smps|watt| 80\+|80 plus') THEN 'Power Supply / SMPS'
WHEN regexp_matches(n, 'cabinet|case|chassis|tower') THEN 'Cabinet'
WHEN regexp_matches(n, 'monitor|display|screen|hz|curved') THEN 'Monitor'
WHEN n LIKE '%keyboard%' THEN 'Keyboard'
WHEN n LIKE '%mouse%' AND n NOT LIKE '%pad%' THEN 'Mouse'
WHEN regexp_matches(n, 'headset|headphone|earphone') THEN 'Headset'
WHEN regexp_matches(n, 'webcam|camera') THEN 'Webcam' ELSE c END"""


def _number(pattern: str, kind: str = "INT") -> str:
    return f"TRY_CAST(nullif(regexp_extract(t, '{pattern}', 1), '') AS {kind})"


#: The best of several chips in one text is the one that the rules name first.
_FIRST_CHIP = "CASE " + " ".join(f"WHEN t LIKE '%rtx {m}%' THEN '{m}'" for m in ("5090", "5080", "5070 ti", "5070", "5060 ti", "5060")) + " END"
_AM5, _DDR5 = "regexp_matches(t, 'am5|b[68]50|x[68]70')", "regexp_matches(t, 'am5|b[68]50|x[68]70|z890|lga1851')"

SPECS = {
    "cpu": {
        "socket": "CASE WHEN t LIKE '%am5%' THEN 'AM5' WHEN regexp_matches(t, 'lga ?1700|1[234]th gen') THEN 'LGA1700' WHEN regexp_matches(t, 'lga1851|core ultra') THEN 'LGA1851' WHEN t LIKE '%am4%' THEN 'AM4' END",
        "cores": _number(r"(\d+)\s?-?\s?cores?"), "threads": _number(r"(\d+)\s?-?\s?threads?"), "boost_clock": _number(r"(\d+\.\d+)\s?ghz", "DOUBLE"), "tdp": _number(r"(\d+)\s?w\b"),
        "integrated_graphics": r"NOT (list_contains(regexp_split_to_array(name, '\s+'), 'f') OR t LIKE '%no graphics%')",
    },
    "gpu": {
        "chipset": f"'RTX ' || replace({_FIRST_CHIP}, ' ti', ' Ti')", "memory_size_gb": f"map {{'5090': 32, '5080': 16, '5070 ti': 16, '5070': 12, '5060 ti': 8, '5060': 8}}[{_FIRST_CHIP}]",
        "recommended_psu": f"map {{'5090': 1000, '5080': 850, '5070 ti': 750, '5070': 650, '5060 ti': 650, '5060': 550}}[{_FIRST_CHIP}]", "memory_type": "CASE WHEN t LIKE '%gddr7%' THEN 'GDDR7' ELSE 'GDDR6' END",
    },
    "motherboard": {
        "socket": f"CASE WHEN {_AM5} THEN 'AM5' WHEN regexp_matches(t, 'z890|lga1851') THEN 'LGA1851' WHEN regexp_matches(t, 'z790|b760|lga1700') THEN 'LGA1700' WHEN regexp_matches(t, 'am4|b550') THEN 'AM4' END",
        "memory_type": f"CASE WHEN {_DDR5} THEN 'DDR5' WHEN regexp_matches(t, 'z790|b760|lga1700') THEN CASE WHEN t LIKE '%ddr4%' THEN 'DDR4' ELSE 'DDR5' END WHEN regexp_matches(t, 'am4|b550') THEN 'DDR4' END",
        "form_factor": "CASE WHEN regexp_matches(t, 'micro-atx|m-?atx') THEN 'Micro-ATX' WHEN t LIKE '%itx%' THEN 'Mini-ITX' WHEN regexp_matches(t, 'e-?atx') THEN 'E-ATX' ELSE 'ATX' END",
    },
    "ram": {"memory_type": "CASE WHEN t LIKE '%ddr4%' THEN 'DDR4' ELSE 'DDR5' END", "speed_mhz": _number(r"(\d{4})\s?mhz"), "capacity_gb": _number(r"(\d+)\s?gb")},
    "psu": {"wattage": _number(r"(\d{3,4})\s?w\b"), "efficiency_rating": "'80+ ' || CASE WHEN t LIKE '%platinum%' THEN 'Platinum' WHEN t LIKE '%gold%' THEN 'Gold' WHEN t LIKE '%bronze%' THEN 'Bronze' END"},
    "cabinet": {"form_factor": "CASE WHEN regexp_matches(t, '(full|super) tower') THEN 'Full Tower' WHEN t LIKE '%itx%' THEN 'Mini-ITX' WHEN regexp_matches(t, 'micro-atx|matx') THEN 'Micro-ATX' ELSE 'Mid Tower' END"},
    "cooler": {"cooler_type": "CASE WHEN regexp_matches(t, 'liquid|aio|(12|24|36|42)0mm') THEN 'Liquid' ELSE 'Air' END", "radiator_size_mm": "CASE WHEN t LIKE '%360%' THEN 360 WHEN t LIKE '%240%' THEN 240 WHEN t LIKE '%420%' THEN 420 WHEN t LIKE '%120%' THEN 120 END"},
    "ssd": {"interface": "CASE WHEN regexp_matches(t, 'nvme|m\\.2|gen[345]') THEN 'M.2 NVMe' WHEN regexp_matches(t, 'sata|hdd|hard drive') THEN 'SATA' END", "capacity_gb": _number(r"(\d+)\s?(tb|gb)") + r" * CASE regexp_extract(t, '\d+\s?(tb|gb)', 1) WHEN 'tb' THEN 1000 ELSE 1 END"},
    "monitor": {
        "screen_size_inch": _number(r'(\d{2}\.?\d?)\s?(?:inch|"|-inch)', "DOUBLE"), "refresh_rate_hz": _number(r"(\d{2,3})\s?hz"),
        "resolution": "CASE WHEN regexp_matches(t, '4k|3840x2160') THEN '3840x2160' WHEN regexp_matches(t, '2k|qhd|2560x1440|1440p') THEN '2560x1440' WHEN regexp_matches(t, 'fhd|1080p|1920x1080') THEN '1920x1080' END",
    },
}

#: The normalizer for a category, by the exact names of the coarse classifier's dispatch.
KIND = """CASE WHEN {0} IN ('CPU', 'Processor', 'CPU Processor') THEN 'cpu' WHEN {0} IN ('GPU', 'Graphics Card') THEN 'gpu' WHEN {0} = 'Motherboard' THEN 'motherboard'
WHEN {0} IN ('RAM', 'Desktop RAM', 'Laptop RAM', 'Memory / RAM', 'RAM Memory') THEN 'ram' WHEN {0} IN ('PSU', 'Power Supply', 'Power Supply / SMPS', 'SMPS') THEN 'psu' WHEN {0} = 'Cabinet' THEN 'cabinet'
WHEN {0} IN ('CPU Cooler', 'Cooler') THEN 'cooler' WHEN regexp_matches({0}, 'SSD|HDD|Storage|Hard Drive|Disk') THEN 'ssd' WHEN {0} LIKE '%Monitor%' THEN 'monitor' END"""
#: The same for granular names as well.
GRANULAR_KIND = """CASE WHEN {0} IN ('Power Supply / SMPS') THEN 'psu' WHEN {0} = 'Cabinet' THEN 'cabinet' WHEN regexp_matches({0}, 'SSD|HDD') THEN 'ssd' WHEN {0} = 'Monitor' THEN 'monitor' WHEN {0} LIKE '%Cooler' THEN 'cooler'
WHEN {0} LIKE '%Motherboard' THEN 'motherboard' WHEN {0} LIKE '%Processor' THEN 'cpu' WHEN regexp_matches({0}, 'RTX|Graphics Card') THEN 'gpu' WHEN {0} LIKE '%RAM%' THEN 'ram' END"""
