"""Tables of an SQL dump and the configuration of shops as data sources.

`sql_dump` reads the lines of a file in byte ranges, several tasks side by side, of which each takes
as many ranges as make up its share. Each line belongs to
the range in which it begins and comes with its offset, so the order of rows is in the data. A table
is the lines between COPY ... FROM stdin and its end mark: one pass over the ranges finds the marks, a few rows,
and a second reads the table's own bytes only.

Files are opened through pyarrow, in any file system that it reads by url.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of one range; a line may be longer. What a task takes where ranges are smaller, and into how many tasks less than that is dealt.
SPLIT = 64 << 20
_TASKS = 32
#: Bytes that are read at once, and beyond the end of a range.
_CHUNK, _AHEAD = 1 << 20, 1 << 12
#: Lines that frame tables.
_MARK = re.compile(rb"^(?:COPY [^\n]*|\\\.\r?)$", re.M)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    url = path if re.match(r"[a-z][a-z0-9+.-]*:", path) else "file://" + path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", url))


def _files(path: str) -> list[tuple[str, int]]:
    """Files (path, bytes) of a folder, in order of their names, or of one file."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(at, recursive=False))
        return sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(at, info.size)]


class Range(InputPartition):
    """Bytes of a file; lines that begin in them."""

    def __init__(self, file: int, path: str, start: int, end: int):
        self.file, self.path, self.start, self.end = file, path, start, end


class Share(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def _blocks(f: pa.NativeFile, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin in the range, whole lines with their ends; the last one of a file may have none."""
    # A line begins in the range if the byte before it, which may lie outside, ends another.
    at = max(part.start - 1, 0)
    f.seek(at)
    rest, skip = b"", part.start > 0
    while at < part.end:
        # Of a long line more is read each time, so that it is not put together again and again.
        more = f.read(min(_CHUNK, max(part.end - at - len(rest), 0) + _AHEAD) + len(rest))
        data = rest + more
        if skip:
            if cut := data.find(b"\n") + 1:
                skip = False
            at, data = at + (cut or len(data)), data[cut:] if cut else b""
        if at >= part.end:
            return
        left = part.end - at
        cut = data.find(b"\n", left - 1) + 1 if len(data) >= left else 0
        if cut or not more:
            if data:
                yield at, data[: cut or None]
            return
        cut = data.rfind(b"\n") + 1
        if cut:
            yield at, data[:cut]
        at, rest = at + cut, data[cut:]


def _lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in the range."""
    with system.open_input_file(part.path) as f:
        for at, block in _blocks(f, part):
            for line in block.removesuffix(b"\n").split(b"\n"):
                yield at, line.removesuffix(b"\r")
                at += len(line) + 1


def _rows(at: int, block: bytes, marks: bool) -> tuple[np.ndarray, list[str]]:
    """Offsets and texts of the lines of a block, or of those alone that frame tables."""
    if marks:
        found = list(_MARK.finditer(block)) if b"COPY " in block or b"\\." in block else []
        starts, lines = np.array([m.start() for m in found], np.int64), [m[0].decode(errors="replace") for m in found]
    else:
        ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
        lines = block.decode(errors="replace").split("\n")
        if block.endswith(b"\n"):  # nothing follows the last end of a line
            ends = ends[:-1]
            lines.pop()
        starts = np.append(0, ends + 1)
    return at + starts, [x.removesuffix("\r") for x in lines] if b"\r" in block else lines


class _DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.marks = options["path"], options.get("marks") == "true"
        self.split = int(options.get("split", SPLIT))
        self.spans = json.loads(options["spans"]) if "spans" in options else None

    def partitions(self) -> list[Share]:
        files = _files(self.path)
        spans = [(k, 0, None) for k in range(len(files))] if self.spans is None else self.spans
        ranges = []
        for k, first, last in spans:
            path, size = files[k]
            last = size if last is None else last
            ranges += [Range(k, path, at, min(at + self.split, last)) for at in range(first, last, self.split)]
        share, out, taken = min(SPLIT, sum(r.end - r.start for r in ranges) // _TASKS), [], 0
        for r in ranges:
            if not out or taken + (r.end - r.start) > max(share, self.split):
                out.append(Share([]))
                taken = 0
            out[-1].ranges.append(r)
            taken += r.end - r.start
        return out

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        system = _opened(self.path)[0]
        for path, ranges in itertools.groupby(part.ranges, lambda r: r.path):
            with system.open_input_file(path) as f:
                for r in ranges:
                    for at, block in _blocks(f, r):
                        starts, lines = _rows(at, block, self.marks)
                        if lines:
                            yield pa.record_batch({"file": pa.array(np.full(len(lines), r.file, np.int32)), "at": pa.array(starts), "line": pa.array(lines, pa.string())})


class DumpSource(DataSource):
    """Lines of a dump (file, at, line); option marks keeps those alone that frame tables."""

    @classmethod
    def name(cls) -> str:
        return "sql_dump"

    def schema(self) -> str:
        return "file int, at long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DumpReader(self.options)


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(DumpSource)
    return spark.read.format("sql_dump").options(path=path, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def _cell(text: Column) -> Column:
    # A doubled backslash is set aside first, so that it does not start another escape.
    plain = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for escape, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")):
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    return F.when(text != "\\N", plain)


def dump_table(spark: SparkSession, path: str, table: str, split: int = SPLIT, place: str | None = None) -> DataFrame:
    """One table of a dump file, all columns as text; a null cell is null.

    Of a folder, the table is what all its files hold of it, as dumps in several files have it. Only the
    lines that frame tables reach the driver. A table that the dump lacks is an error; one
    without an end mark goes to the end of its file. place names a column (file, at) that says where
    a row stands, by which rows may be ordered.
    """
    head = re.compile(rf"^COPY (?:\w+\.)?{re.escape(table)} \((.*)\) FROM stdin;$")
    marks, spans, columns = sorted(map(tuple, _read(spark, path, split=split, marks=True).collect())), [], None
    for k, (file, at, line) in enumerate(marks):
        if found := head.match(line):
            own = [c.strip().strip('"') for c in found[1].split(",")]
            if columns not in (None, own):
                raise ValueError(f"files disagree on the columns of {table}")
            columns = own
            spans.append((file, at + 1, next((a for f, a, line in marks[k + 1 :] if f == file and line == "\\."), None)))
    if columns is None:
        raise ValueError(f"no table {table} in the dump")
    cells = _read(spark, path, split=split, spans=json.dumps(spans)).select(F.struct("file", "at").alias("place"), F.split("line", "\t").alias("cells"))
    at = [F.col("place").alias(place)] if place else []
    return cells.select(*at, *[_cell(F.get("cells", F.lit(n))).alias(c) for n, c in enumerate(columns)])


#: A shop of a configuration file: its address and what its pages are read by.
SHOP = "name string, display_name string, base_url string, search_url string, currency string, active boolean, platform string, page_endpoint string, selectors map<string,string>, attributes map<string,string>"


class ShopSource(DataSource):
    """Shops of YAML files: a map from name to settings in each; one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "shop_config"

    def schema(self) -> str:
        return SHOP

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShopReader(self.options)


class _ShopReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        return [Range(k, path, 0, size) for k, (path, size) in enumerate(_files(self.path))]

    def read(self, part: Range) -> Iterator[tuple]:
        import yaml

        with _opened(self.path)[0].open_input_file(part.path) as f:
            shops = yaml.safe_load(f.read()) or {}
        text = lambda v: None if v is None else str(v)
        texts = lambda m: {str(k): str(v) for k, v in m.items() if v is not None} if m else None
        for name, s in shops.items():
            s = s or {}
            search = s.get("search_config") or s
            yield (str(name), text(s.get("name")), text(s.get("base_url")), text(s.get("search_url")), text(s.get("currency")), bool(s.get("enabled", True)),
                   text(search.get("platform")), text(search.get("page_endpoint")), texts(search.get("selectors")), texts(search.get("attributes")))


def shops(spark: SparkSession, path: str) -> DataFrame:
    """The configured shops (SHOP). A shop that names no state is active."""
    spark.dataSource.register(ShopSource)
    return spark.read.format("shop_config").options(path=path).load()


#: Platforms that are asked for pages by an endpoint, and what every other shop must say.
BY_ENDPOINT, SELECTORS, ATTRIBUTES = ("shopify", "fleetcart", "nextjs"), ("product_card", "title", "price", "mrp", "image"), ("url", "image")


def faults(configured: DataFrame) -> DataFrame:
    """(name, missing): what a shop's configuration lacks to be read; a sound one gives no row."""
    ends = F.coalesce(F.col("platform").isin(*BY_ENDPOINT), F.lit(False))
    lacks = lambda of, keys: [F.when(~F.coalesce(F.array_contains(F.map_keys(of), k), F.lit(False)), f"{of}.{k}") for k in keys]
    missing = F.when(ends, F.array(F.when(F.col("page_endpoint").isNull(), "page_endpoint"))).otherwise(F.array(*lacks("selectors", SELECTORS), *lacks("attributes", ATTRIBUTES)))
    return configured.select("name", F.explode(F.array_compact(missing)).alias("missing"))


def page_selectors(configured: DataFrame, stores: DataFrame) -> DataFrame:
    """(sid, card, title, price, mrp, image, url_attr, image_attr) of the configured shops that are read by selectors; stores is (id, name)."""
    of = lambda column, key: F.try_element_at(column, F.lit(key))
    s = configured.filter("selectors is not null").join(stores.select(F.col("id").alias("sid"), "name"), "name")
    return s.select("sid", of("selectors", "product_card").alias("card"), *[of("selectors", c).alias(c) for c in SELECTORS[1:]], of("attributes", "url").alias("url_attr"), of("attributes", "image").alias("image_attr"))
