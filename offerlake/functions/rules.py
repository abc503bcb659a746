"""Classification and specification rules as tables, compiled into column expressions.

Expressions read three columns: name (a title), t (title and specifications, lower-cased) and c
(the present category). re'...' marks a regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The first pattern that a lower-cased text meets names its category.
CATEGORY_PATTERNS = (
    (r"\b(rtx\s?\d{4}|rx\s?\d{4}|graphics card|vga|gpu|geforce|radeon)\b", "GPU"),
    (r"\b(ryzen\s?\d{4}|intel core|processor|cpu|i3-|i5-|i7-|i9-|core ultra)\b", "CPU"),
    (r"\b(aio|liquid cooler|cpu cooler|air cooler|radiator|240mm|360mm|420mm|hyper 212|ak620|frozen prism)\b", "CPU Cooler"),
    (r"\b(cabinet|case|chassis|mid tower|full tower|mini itx case|atx case|matx case)\b", "Cabinet"),
    (r'\b(monitor|display|1440p|4k monitor|oled monitor|ips panel|curved monitor|\d{2}\s?inch monitor|\d{2}" monitor|hz)\b', "Monitor"),
    (r"\b(mechanical keyboard|keyboard|keychron)\b", "Keyboard"),
    (r"\b(mouse|wireless mouse|gaming mouse|mx master)\b", "Mouse"),
)
OTHER = "Accessories"

#: Fixed values: (any of these words, none of these, ((words, label), ...), label else). The first
#: group that fits decides, and in it the first label. A tuple among words asks for all its words.
TITLE_GROUPS = (
    (("ryzen", "intel core", "i3-", "i5-", "i7-", "i9-", "ultra 5", "ultra 7", "ultra 9", "threadripper", "processor"), ("cooler", "fan", "motherboard"),
     ((("threadripper",), "Threadripper Processor"), (("intel", "i3-", "i5-", "i7-", "i9-", "ultra"), "Intel Processor"), (("ryzen", "amd"), "AMD Processor")), "Processor"),
    (("motherboard", "mobo", "b450", "b550", "b650", "x570", "x670", "h610", "b760", "z790", "z890"), (),
     ((("intel", "h610", "b760", "z790", "z890", "lga"), "Intel Motherboard"), (("amd", "b450", "b550", "b650", "x570", "x670", "am4", "am5"), "AMD Motherboard")), "Motherboard"),
    (("geforce", "radeon", "graphics card", "rtx", "gtx", "rx ", "gpu"), (),
     ((("rtx 50",), "NVIDIA RTX 50 Series"), (("rtx 40",), "NVIDIA RTX 40 Series"), (("rtx 30",), "NVIDIA RTX 30 Series"), (("radeon", "rx "), "AMD Graphics Card"), (("geforce", "nvidia", "rtx", "gtx"), "Graphics Card (NVIDIA)")), "Graphics Card"),
    (("ddr4", "ddr5", "ram", "memory"), (),
     (((("laptop", "ddr5"), ("so-dimm", "ddr5"), ("sodimm", "ddr5")), "Laptop RAM (DDR5)"), ((("laptop", "ddr4"), ("so-dimm", "ddr4"), ("sodimm", "ddr4")), "Laptop RAM (DDR4)"),
      (("laptop", "so-dimm", "sodimm"), "Laptop RAM"), (("ddr5",), "Desktop RAM (DDR5)"), (("ddr4",), "Desktop RAM (DDR4)")), "Desktop RAM"),
    (("nvme", "ssd", "m.2", "hard drive", "hdd", "solid state"), (),
     (((("hdd", "external"), ("hdd", "portable"), ("hard drive", "external"), ("hard drive", "portable"), ("hard disk", "external"), ("hard disk", "portable")), "External HDD"),
      (("hdd", "hard drive", "hard disk"), "Internal HDD"), (("external", "portable"), "External SSD"), (("gen5",), "Gen5 NVMe SSD"), (("gen4",), "Gen4 NVMe SSD"), (("m.2", "nvme"), "M.2 NVMe SSD"), (("sata",), '2.5" SATA SSD')), "SSD"),
    (("cooler", "cooling", "aio", "fan", "thermal paste"), (), ((("liquid", "aio"), "CPU Liquid Cooler"), (("air",), "CPU Air Cooler")), "CPU Cooler"),
    (("power supply", "psu", "smps", "watt", " 80+", "80 plus"), (), (), "Power Supply / SMPS"),
    (("cabinet", "case", "chassis", "tower"), (), (), "Cabinet"),
    (("monitor", "display", "screen", "hz", "curved"), (), (), "Monitor"),
    (("keyboard",), (), (), "Keyboard"),
    (("mouse",), ("pad",), (), "Mouse"),
    (("headset", "headphone", "earphone"), (), (), "Headset"),
    (("webcam", "camera"), (), (), "Webcam"),
)


def _has(words: tuple) -> str:
    """Whether t has any of the words, or all of those that stand together in a tuple."""
    one = lambda w: f"contains(t, '{w}')"
    return "(" + " or ".join(one(w) if isinstance(w, str) else "(" + " and ".join(map(one, w)) + ")" for w in words) + ")"


def category_sql() -> str:
    """Category of the text t (title, raw category and url)."""
    return "case " + " ".join(f"when regexp_like(t, re'{p}') then '{c}'" for p, c in CATEGORY_PATTERNS) + f" else '{OTHER}' end"


def title_sql() -> str:
    """Granular category of the title t; the present category c where no group fits."""
    out = "case"
    for some, none, parts, other in TITLE_GROUPS:
        inner = "case " + " ".join(f"when {_has(w)} then '{label}'" for w, label in parts) + f" else '{other}' end" if parts else f"'{other}'"
        out += f" when {_has(some)}" + (f" and not {_has(none)}" if none else "") + f" then {inner}"
    return out + " else c end"


def _number(pattern: str, kind: str = "int") -> str:
    return f"try_cast(nullif(regexp_extract(t, re'{pattern}', 1), '') as {kind})"


def _first(*pairs: tuple[tuple, str], default: str = "null") -> str:
    return "case " + " ".join(f"when {_has(w)} then {v}" for w, v in pairs) + f" else {default} end"


#: Words of a chip, its name, memory in GB and recommended supply in W.
CHIPS = (
    ("rtx 5090", "RTX 5090", 32, 1000),
    ("rtx 5080", "RTX 5080", 16, 850),
    ("rtx 5070 ti", "RTX 5070 Ti", 16, 750),
    ("rtx 5070", "RTX 5070", 12, 650),
    ("rtx 5060 ti", "RTX 5060 Ti", 8, 650),
    ("rtx 5060", "RTX 5060", 8, 550),
)
_AM5 = ("am5", "b650", "x870", "b850", "x670")
_LGA1700 = ("z790", "b760", "lga1700")

#: kind -> column -> SQL; null where a rule finds nothing.
SPECS = {
    "cpu": {
        "socket": _first((("am5",), "'AM5'"), (("lga1700", "lga 1700", "14th gen", "13th gen", "12th gen"), "'LGA1700'"), (("lga1851", "core ultra"), "'LGA1851'"), (("am4",), "'AM4'")),
        "cores": _number(r"(\d+)\s?-?\s?(?:core|cores)"),
        "threads": _number(r"(\d+)\s?-?\s?(?:thread|threads)"),
        "boost_clock": _number(r"(\d+\.\d+)\s?ghz", "decimal(4,2)"),
        "tdp": _number(r"(\d+)\s?w\b"),
        "integrated_graphics": r"not (regexp_like(name, re'(^|\s)f(\s|$)') or contains(t, 'no graphics'))",
    },
    "gpu": {
        "chipset": _first(*[((w,), f"'{n}'") for w, n, _, _ in CHIPS]),
        "memory_size_gb": _first(*[((w,), str(m)) for w, _, m, _ in CHIPS]),
        "recommended_psu": _first(*[((w,), str(p)) for w, _, _, p in CHIPS]),
        "memory_type": _first((("gddr7",), "'GDDR7'"), default="'GDDR6'"),
    },
    "motherboard": {
        "socket": _first((_AM5, "'AM5'"), (("z890", "lga1851"), "'LGA1851'"), (_LGA1700, "'LGA1700'"), (("am4", "b550"), "'AM4'")),
        "memory_type": _first(((*_AM5, "z890", "lga1851"), "'DDR5'"), (tuple((w, "ddr4") for w in _LGA1700), "'DDR4'"), (_LGA1700, "'DDR5'"), (("am4", "b550"), "'DDR4'")),
        "form_factor": _first((("micro-atx", "m-atx", "matx"), "'Micro-ATX'"), (("mini-itx", "itx"), "'Mini-ITX'"), (("e-atx", "eatx"), "'E-ATX'"), default="'ATX'"),
    },
    "ram": {"memory_type": _first((("ddr4",), "'DDR4'"), default="'DDR5'"), "speed_mhz": _number(r"(\d{4})\s?mhz"), "capacity_gb": _number(r"(\d+)\s?gb")},
    "psu": {"wattage": _number(r"(\d{3,4})\s?w\b"), "efficiency_rating": _first((("platinum",), "'80+ Platinum'"), (("gold",), "'80+ Gold'"), (("bronze",), "'80+ Bronze'"))},
    "cabinet": {"form_factor": _first((("full tower", "super tower"), "'Full Tower'"), (("mini-itx", "itx"), "'Mini-ITX'"), (("micro-atx", "matx"), "'Micro-ATX'"), default="'Mid Tower'")},
    "cooler": {
        "cooler_type": _first((("liquid", "aio", "360mm", "240mm", "420mm", "120mm"), "'Liquid'"), default="'Air'"),
        "radiator_size_mm": _first((("360",), "360"), (("240",), "240"), (("420",), "420"), (("120",), "120")),
    },
    "ssd": {
        "interface": _first((("nvme", "m.2", "gen4", "gen5", "gen3"), "'M.2 NVMe'"), (("sata", "hdd", "hard drive"), "'SATA'")),
        "capacity_gb": f"{_number(r'(\d+)\s?(?:tb|gb)')} * case when regexp_extract(t, re'\\d+\\s?(tb|gb)', 1) = 'tb' then 1000 else 1 end",
    },
    "monitor": {
        "screen_size_inch": _number(r'(\d{2}\.?\d?)\s?(?:inch|"|-inch)', "decimal(4,1)"),
        "refresh_rate_hz": _number(r"(\d{2,3})\s?hz"),
        "resolution": _first((("4k", "3840x2160"), "'3840x2160'"), (("2k", "qhd", "2560x1440", "1440p"), "'2560x1440'"), (("fhd", "1080p", "1920x1080"), "'1920x1080'")),
    },
}

#: Category names whose products each normalizer takes, and words that also decide.
KIND_NAMES = {
    "cpu": ("CPU", "Processor", "CPU Processor"),
    "gpu": ("GPU", "Graphics Card"),
    "motherboard": ("Motherboard",),
    "ram": ("RAM", "Desktop RAM", "Laptop RAM", "Memory / RAM", "RAM Memory"),
    "psu": ("PSU", "Power Supply", "Power Supply / SMPS", "SMPS"),
    "cabinet": ("Cabinet",),
    "cooler": ("CPU Cooler", "Cooler"),
}
KIND_WORDS = (("ssd", ("SSD", "HDD", "Storage", "Hard Drive", "Disk")), ("monitor", ("Monitor",)))
#: Granular categories of title_sql() that mean the same kinds though their names are in no set above.
GRANULAR_WORDS = (("cooler", "Cooler"), ("motherboard", "Motherboard"), ("cpu", "Processor"), ("gpu", "RTX"), ("gpu", "Graphics Card"), ("ram", "RAM"))


def column(sql: str) -> Column:
    """The expression over the columns name, t and c as a Spark column."""
    return F.expr(sql.replace("re'", "r'"))


def kind_of(category: Column, granular: bool = False) -> Column:
    """The normalizer that takes a category; null for none. granular also maps the names of title_sql()."""
    out = F.lit(None).cast("string")
    rest = [(kind, (word,)) for kind, word in GRANULAR_WORDS] if granular else []
    for kind, words in reversed([*KIND_WORDS, *rest]):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(category, F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    for kind, names in KIND_NAMES.items():
        out = F.when(category.isin(*names), kind).otherwise(out)
    return out
