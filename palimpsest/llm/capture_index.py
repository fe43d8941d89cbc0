"""Two-level capture index: compressed blocks of sorted reversed-host URL keys under a sparse block directory."""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

BLOCK_LINES = 3000


def surt(url: Column) -> Column:
    """Reversed-host key: 'https://Blog.a.com:80/x?y#z' -> 'com,a,blog)/x?y'. Scheme, user, port, 'www.' and fragment go."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(host == "", F.lower(url)).otherwise(key)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _plain(key: str) -> str:
    """The key as it stands in lines, blocks and the directory, and as it is sorted: without tab and line end, each key its own."""
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A")


def _plain_column(key: Column) -> Column:
    return F.replace(F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


class CaptureIndex:
    """An index in the shared folder. `directory` has a row for each block: first_key, last_key, file, offset, length, lines."""

    def __init__(self, spark: SparkSession, path: str, directory: DataFrame):
        self.spark, self.path, self.directory = spark, path, directory

    @classmethod
    def build(cls, captures: DataFrame, path: str | None = None, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        """captures: key STRING and other columns, all kept as JSON in the line. Rows without a key are left out.

        The captures are range-partitioned by key and all else, so that a key with very many captures spreads over shards too;
        each shard is one file of zlib blocks of block_lines lines in key order. A task that runs twice writes
        two files, of which the directory names one.
        """
        spark = captures.sparkSession
        path = path or fresh_path(spark, "captures")
        line = F.to_json(F.struct(*[c for c in captures.columns if c != "key"]), {"ignoreNullFields": "false"}).alias("line")
        rows = captures.where("key is not null").select(_plain_column(F.col("key")).alias("key"), line)
        rows = rows.repartitionByRange("key", "line").sortWithinPartitions("key", "line")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _open(path)
            fs.create_dir(root, recursive=True)
            name, entries, held, out, at = f"shard-{uuid.uuid4().hex}.z", [], [], None, 0

            def flush() -> None:
                nonlocal at, held, out
                out = out or fs.open_output_stream(f"{root}/{name}")
                data = zlib.compress("".join(f"{k}\t{v}\n" for k, v in held).encode(), 6)
                out.write(data)
                entries.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
                at, held = at + len(data), []

            for b in batches:
                for kv in zip(b["key"].to_pylist(), b["line"].to_pylist(), strict=True):
                    held.append(kv)
                    if len(held) == block_lines:
                        flush()
            if held:
                flush()
            if out:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*entries, strict=True)], ["first_key", "last_key", "file", "offset", "length", "lines"])

        directory = rows.mapInArrow(write, "first_key string, last_key string, file string, offset long, length long, lines long")
        return cls(spark, path, materialize(directory, "directory"))

    def resolve(self, queries: DataFrame) -> DataFrame:
        """(key, captures, first_id, last_id) for each distinct non-null key of queries (key STRING); 0 and nulls where it has none.

        Keys are range-partitioned and sorted. Each task fetches the directory entries that overlap its own range of keys (a
        filtered scan of the directory files whose range meets it, not a broadcast), binary-searches them for each key, and range-reads
        the blocks found, one at a time. The driver knows the range of each directory file, a row for each task that built the index.
        """
        path, folder = self.path, self.ranges()
        keys = queries.select("key", _plain_column(F.col("key")).alias("plain")).where("key is not null").distinct()
        keys = keys.repartitionByRange("plain").sortWithinPartitions("plain")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _open(path)
            reader = None
            for b in batches:
                want = b["plain"].to_pylist()
                if want:
                    reader = reader or BlockReader(fs, root, folder)
                    reader.cover(want[0], want[-1])
                    found = [reader.find(k) for k in want]
                    yield pa.RecordBatch.from_arrays([b["key"], *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], ["key", "captures", "first_id", "last_id"])

        return keys.mapInArrow(look, "key string, captures long, first_id long, last_id long")

    def lookup(self, url_key: str) -> list[dict]:
        """The captures of one key, read by the driver: the blocks whose range holds it, and nothing else."""
        fs, root = _open(self.path)
        reader, key = BlockReader(fs, root, self.ranges()), _plain(url_key)
        reader.cover(key, key)
        return [json.loads(x) for x in reader.lines(key)]

    def ranges(self) -> list[tuple[str, str, str]]:
        """(file, first key, last key) of each file of the directory."""
        per = self.directory.groupBy(F.input_file_name().alias("f")).agg(F.min("first_key").alias("a"), F.max("last_key").alias("b"))
        return [tuple(r) for r in per.collect()]


class BlockReader:
    """Looks keys up in ascending order; holds one decompressed block, and the part of the directory from there on."""

    def __init__(self, fs, root: str, files: list[tuple[str, str, str]]):
        self.fs, self.root, self.files, self.open = fs, root, sorted(files), {}
        self.first: list[str] = []
        self.entries: list[tuple] = []
        self.at, self.block, self.name = None, [], []

    def cover(self, low: str, high: str) -> None:
        """Fetch the directory entries whose range of keys meets [low, high]; Parquet statistics skip the rest."""
        import pyarrow.dataset as ds

        got, still = [], {}
        for name, first, last in self.files:
            if first <= high and last >= low:  # a file stays open from batch to batch while it is needed
                fs, at = _open(name)
                still[name] = self.open.get(name) or ds.dataset(at, filesystem=fs, format="parquet")
                got += still[name].to_table(filter=(ds.field("last_key") >= low) & (ds.field("first_key") <= high)).to_pylist()
        self.open = still
        got.sort(key=lambda e: (e["first_key"], e["last_key"]))
        self.entries = [(e["first_key"], e["last_key"], e["file"], e["offset"], e["length"]) for e in got]
        self.first = [e[0] for e in self.entries]

    def lines(self, key: str) -> Iterator[str]:
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.entries) and self.first[i] <= key:
            if self.entries[i][1] >= key:
                yield from self._in_block(i, key)
            i += 1

    def _in_block(self, i: int, key: str) -> Iterator[str]:
        _, _, name, offset, length = self.entries[i]
        if self.at != (name, offset):
            with self.fs.open_input_file(f"{self.root}/{name}") as f:
                f.seek(offset)
                rows = zlib.decompress(f.read(length)).decode().split("\n")[:-1]
            self.block = [r.partition("\t")[::2] for r in rows]
            self.name, self.at = [r[0] for r in self.block], (name, offset)
        for j in range(bisect.bisect_left(self.name, key), len(self.block)):
            if self.name[j] != key:
                break
            yield self.block[j][1]

    def find(self, key: str) -> tuple[int, int | None, int | None]:
        n, low, high = 0, None, None
        for line in self.lines(key):
            n, i = n + 1, json.loads(line)["page_id"]
            if i is not None:
                low, high = i if low is None else min(low, i), i if high is None else max(high, i)
        return n, low, high


def captures_of(pages: DataFrame) -> DataFrame:
    """Capture lines of pages: key, page_id, url, length and digest of the page. A null url gives a null key."""
    return pages.select(surt(F.col("url")).alias("key"), "page_id", "url", F.octet_length("html").alias("length"), F.md5(F.col("html")).alias("digest"))


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all pages, then resolve the URL of every page through the index.

    Rows: key, captures, first_id, last_id for each distinct key. Pages with a null url have none; repeated URLs and rows are
    further captures of their key; a url without a host is its own key in lower case, an empty one the empty key; null html has null length
    and digest. Keys of any length and with any character, tab and line end too, are kept apart. An empty table gives no rows. Other
    columns are not read.
    """
    captures = captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    index = CaptureIndex.build(captures)
    return index.resolve(captures)


SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path, url FROM pages WHERE url IS NOT NULL),
k AS (SELECT page_id, CASE WHEN host = '' THEN lower(url) ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS key FROM p)
SELECT key, count(*) AS captures, min(page_id) AS first_id, max(page_id) AS last_id FROM k GROUP BY key
"""
