"""WARC archives and a two-level capture index.

Writing: a record per page, each a gzip member of its own, in archive files
that every task names uniquely.  Of pages with equal payloads of at least
``least`` bytes, the smallest page_id is a response and the others are revisits
that carry its HTTP headers but not its payload again.

Indexing: captures are sorted by the key of their URL, whose host is reversed
(``com,example,www)/path``), and packed into compressed blocks; a sparse
directory has one row a block: its first and last key and where it lies.
``lookup`` binary-searches the directory for each asked key, reads only the
blocks that can hold it, binary-searches their lines and reads only the ranges
of the records found; ``look_up_all`` does so for the keys of a whole table.
``read_back`` walks the whole index instead.  The captures found are dealt to
stretches of the archives, and a stretch's records are read as few merged
ranges.

Files are opened with pyarrow's file systems, so the folder can be on any
store they know.  What a lost task left behind is in no index and is ignored.

Edge cases: a null html is the empty payload; a null url has the empty key; a
null page_id is never a response that others refer to; rows that repeat the
smallest page_id of a group are all responses; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, partitions, written

LEAST = 100
BLOCK_LINES = 512
STRETCH = 8 << 20
GAP = 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: A directory up to this size is searched by every task as it is; a larger one is split by its own coarser keys.
DIRECTORY_BYTES = 32 << 20

INDEX = "key string, page_id long, kind string, file string, at long, size long"


def opened(path: str):
    """The file system of a path and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host reversed by commas, without scheme, port 80/443, user or fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    tail = f":{port}" if port and port not in ("80", "443") else ""
    return ",".join(reversed(name.rstrip(".").split("."))) + tail + ")" + (path if path[0] == "/" else "/" + path)


# ---- writing


def _record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the archives; returns the captures (``INDEX`` columns), themselves a table in ``folder``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    own = own.withColumn("row", F.xxhash64("page_id", "url", "digest"))
    long = own.filter(F.octet_length("html") >= least).select("row", "page_id", "digest")
    # Groups are found with digests and ids alone; their counts are summed before the shuffle, whatever a group's size.
    # The pages meet their group's head by a hash of the row, so no key is hot, not even that of the empty page.
    groups = long.groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("digest", "head")
    heads = long.join(groups, "digest").select(F.col("row").alias("its_row"), F.col("page_id").alias("its_id"), F.col("digest").alias("its_digest"), "head").distinct()
    same = (F.col("row") == F.col("its_row")) & F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest"))
    marked = own.join(heads, same, "left")

    def run(batches):
        out, path, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, head in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    kind = "response" if head is None or page_id == head else "revisit"
                    payload = html.encode()
                    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packed.compress(_record(kind, page_id, url, payload, digest, head, len(payload))) + packed.flush()
                    if out is None:
                        fs, where = opened(folder)
                        path = f"part-{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(where, recursive=True)
                        out, at = fs.open_output_stream(f"{where}/{path}", compression=None), 0
                    out.write(member)
                    rows.append((url_key(url), page_id, kind, path, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "page_id", "kind", "file", "at", "size"],
                )
        finally:
            if out is not None:
                out.close()

    captures = marked.select("page_id", "url", "html", "digest", "head").mapInArrow(run, INDEX)
    captures.write.option("compression", "zstd").parquet(f"{folder}-captures")
    return pages.sparkSession.read.schema(captures.schema).parquet(f"{folder}-captures")


# ---- the index


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures into compressed blocks under ``folder``; returns the directory (first, last, n, file, at, size)."""
    n = partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")

    def run(batches):
        out, held = None, []
        at = 0

        def flush():
            nonlocal out, at, path
            if out is None:
                fs, where = opened(folder)
                path = f"index-{uuid.uuid4().hex}.zipnum"
                fs.create_dir(where, recursive=True)
                out = fs.open_output_stream(f"{where}/{path}", compression=None)
            packed = gzip.compress("".join(_line(r) for r in held).encode(), 6, mtime=0)
            out.write(packed)
            row = (held[0][0], held[-1][0], len(held), path, at, len(packed))
            at += len(packed)
            held.clear()
            return row

        path = None
        try:
            for batch in batches:
                rows = []
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(r)
                    if len(held) >= lines:
                        rows.append(flush())
                if rows:
                    yield _directory(rows)
            if held:
                yield _directory([flush()])
        finally:
            if out is not None:
                out.close()

    return written(ordered.mapInArrow(run, "first string, last string, n long, file string, at long, size long"), "directory")


def _directory(rows):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["first", "last", "n", "file", "at", "size"])


def _line(row) -> str:
    key, page_id, kind, file, at, size = row
    safe = key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")
    return f"{safe}\t{'' if page_id is None else page_id}\t{kind}\t{file}\t{at}\t{size}\n"


def _lines(packed: bytes) -> list[tuple]:
    out = []
    for line in gzip.decompress(packed).decode().split("\n")[:-1]:
        key, page_id, kind, file, at, size = line.split("\t")
        key = key.replace("%0D", "\r").replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")
        out.append((key, int(page_id) if page_id else None, kind, file, int(at), int(size)))
    return out


def _captures_of(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "page_id", "kind", "file", "at", "size"])


class _Reader:
    """Ranges of the files of a folder; keeps the last file open."""

    def __init__(self, folder: str):
        self.fs, self.where = opened(folder)
        self.name, self.file = None, None

    def __call__(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.where}/{name}")
        self.file.seek(at)
        return self.file.read(size)


def scan_index(directory: DataFrame, folder: str) -> DataFrame:
    """All captures, from the index's blocks."""

    def run(batches):
        read = _Reader(folder)
        for batch in batches:
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                yield _captures_of(_lines(read(file, at, size)))

    n = partitions(directory.sparkSession)
    return directory.select("file", "at", "size").repartition(n).mapInArrow(run, INDEX)


def search(keys: DataFrame, directory: DataFrame, folder: str, most_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """(key, page_id, kind, file, at, size): the captures of distinct ``keys``, by binary search.

    The sparse directory (a few bytes for each ``BLOCK_LINES`` captures) tells
    which blocks can hold a key; only those are read, each once, and searched.
    Up to ``most_bytes`` of directory every task searches it whole; beyond, it
    is searched in pieces of that size, in turn.
    """
    spark = keys.sparkSession
    size = directory.agg(F.sum(F.octet_length("first") + F.octet_length("last") + 40)).first()[0] or 0
    pieces = int(size // most_bytes) + 1
    found = None
    for k in range(pieces):
        part = directory if pieces == 1 else directory.filter(F.pmod(F.xxhash64("file", "at"), F.lit(pieces)) == k)
        rows = sorted((r["first"], r["last"], r["file"], r["at"], r["size"]) for r in part.collect())
        shared = spark.sparkContext.broadcast(rows)

        def find(batches, shared=shared):
            rows = shared.value
            firsts = [r[0] for r in rows]
            for batch in batches:
                out = []
                for key in batch.column(0).to_pylist():
                    i = bisect_right(firsts, key) - 1
                    while i >= 0 and rows[i][1] >= key:  # a key can fill several blocks
                        out.append((key, *rows[i][2:]))
                        i -= 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "size"])

        hits = keys.mapInArrow(find, "key string, file string, at long, size long")
        found = hits if found is None else found.unionByName(hits)

    def blocks(batches):
        read, last, lines, firsts = _Reader(folder), None, [], []
        for batch in batches:
            out = []
            for key, file, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, at) != last:
                    last, lines = (file, at), _lines(read(file, at, size))
                    firsts = [r[0] for r in lines]
                out += lines[bisect_left(firsts, key) : bisect_right(firsts, key)]
            yield _captures_of(out)

    n = partitions(spark)
    return found.repartition(n, "file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(blocks, INDEX)


def keys_of(urls: DataFrame) -> DataFrame:
    """(url, key): each distinct ``url`` (null is one) with its reversed-host key."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["url", "key"])

    return urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(run, "url string, key string")


def lookup(urls: DataFrame, directory: DataFrame, folder: str, archives: str, most_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """Records of the asked URLs (``url``): (url, page_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    asked = keys_of(urls.filter("url is not null"))
    found = search(asked.select("key").distinct(), directory, folder, most_bytes)
    return _records(asked.join(found, "key").select("url", "page_id", "kind", "file", "at", "size"), archives, payload=True)


def look_up_all(pages: DataFrame, directory: DataFrame, folder: str, archives: str) -> DataFrame:
    """The records of all ``pages`` (url), found through the index by their keys: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    return _records(search(keys_of(pages).select("key").distinct(), directory, folder), archives)


def _parse(member: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers to, payload) of a record; a response's are of the payload read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    ident = lambda k: int(v) if (v := fields[k][len("<urn:page:") : -1]) else None
    told = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != told or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        return ident("WARC-Record-ID"), told, digest, kind, None, payload
    return ident("WARC-Record-ID"), told, digest, kind, ident("WARC-Refers-To"), None


def _records(captures: DataFrame, archives: str, payload: bool = False) -> DataFrame:
    """Read the records of captures: near ones of a file together, in merged ranges."""
    extra = [c for c in captures.columns if c == "url"]
    n = partitions(captures.sparkSession)
    dealt = captures.repartition(n, "file", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("file", "at").select(*extra, "file", "at", "size")
    schema = ", ".join([*(f"{c} string" for c in extra), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"] + ["payload binary"] * payload)
    kinds = [pa.string() for _ in extra] + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [*extra, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def run(batches):
        read = _Reader(archives)
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                file, at, size = (part.column(i + len(extra)).to_pylist() for i in range(3))
                more = [part.column(i).to_pylist() for i in range(len(extra))]
                out, i = [], 0
                while i < len(file):
                    j, end = i + 1, at[i] + size[i]
                    while j < len(file) and file[j] == file[i] and at[j] <= end + GAP and at[j] - at[i] < STRETCH:
                        end = max(end, at[j] + size[j])
                        j += 1
                    data = read(file[i], at[i], end - at[i])
                    for k in range(i, j):
                        got = _parse(data[at[k] - at[i] : at[k] - at[i] + size[k]])
                        out.append((*(m[k] for m in more), *got[: 5 + payload]))
                    i = j
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    return dealt.mapInArrow(run, schema)


def read_back(directory: DataFrame, index: str, archives: str) -> DataFrame:
    """Every record of the archives, through the index."""
    return _records(scan_index(directory, index), archives)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[DataFrame, str, str]:
    """Write and index pages; returns (directory, index folder, archive folder)."""
    folder = folder or fresh(spark, "warc")
    captures = write(pages, folder, least)
    return build_index(captures, f"{folder}-index"), f"{folder}-index", folder
