"""WARC archives of pages, and a two-level capture index over them.

Writing: each task writes one archive of gzip members, one record a member.  Of pages
with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id
is a ``response``; the others are ``revisit`` records that refer to it.

Index: captures are sorted by (reversed-host key, page_id) and written in compressed
blocks, one file for each range of keys.  A file ends in its directory, which has the
first capture and the place of each block; the list of files with their first captures is
the level above, as long as the number of ranges.  A lookup binary-searches the list, then
the directory, reads one block by range, binary-searches it, and reads one record by range.

Reading: a task streams each archive, parses the records and hashes the payloads; the
payload of a revisit is found through the index.

Tasks may run twice: archives and index files have a name of their own for each attempt,
and only those of the attempt that Spark commits are listed.

Edge cases: a null html is an empty payload; a null or odd url gets a ``urn:page:`` target;
control characters in urls are escaped; rows that repeat the smallest page_id of a payload
are responses too, and each record has an id of its own; a null page_id is never a revisit and none refers to it; other columns
are ignored; no pages give no archives and an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

REVISIT_BYTES = 100
#: Captures in a block of the index.
BLOCK_LINES = 3000
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_MAGIC = b"CAPIDX01"

CAPTURES = "key string, page_id long, url string, kind string, digest string, file string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def target(url: str | None, page_id: int | None) -> str:
    """What a record names as its target."""
    if not url or not url.strip():
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) if ord(c) < 256 else c for c in url.strip())


def host_key(uri: str) -> str:
    """Sort key of a target: the host's labels reversed, then port, path and query."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return uri
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:].partition("#")[0]
    name, colon, port = host.partition(":")
    if (scheme.lower(), port) in (("http", "80"), ("https", "443")):
        colon = port = ""
    labels = [x for x in name.split(".") if x]
    return ",".join(reversed(labels)) + colon + port + ")" + (path or "/")


def record_id(page_id: int | None, uri: str, nth: str = "") -> str:
    """The id of a record; nth tells apart those of equal page_id and target."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {nth}'.rstrip())}>"


def encode_record(page_id: int | None, uri: str, payload: bytes, digest: str, refers: tuple[int, str] | None, nth: str = "") -> bytes:
    """One record, not compressed. refers: page_id and target of the response it revisits; nth: see record_id."""
    http = (_HTTP % len(payload)).encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, uri, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*refers)}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers[0]}"]
    block = http if refers else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it says")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip stream, one after the other; memory for one member."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(size):
        out.append(z.decompress(chunk))
        rest = b""
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared.file_system(folder)
        file, out, offset = "", None, 0
        for batch in batches:
            for b in shared.slices(batch, "html", 4_000_000):
                rows = []
                for page, url, html, digest, nth, first, first_nth, first_url in zip(*(c.to_pylist() for c in shared.columns(b, "page_id", "url", "html", "digest", "nth", "first", "first_nth", "first_url")), strict=True):
                    if out is None:
                        file = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{file}", compression=None)  # the members are compressed already
                    uri = target(url, page)
                    refers = None if first is None or page is None or page <= first else (first, target(first_url, first))
                    data = _gzip(encode_record(page, uri, (html or "").encode(), digest, refers, "" if nth == first_nth else str(nth)))
                    out.write(data)
                    rows.append((host_key(uri), page, uri, "revisit" if refers else "response", digest, file, offset, len(data)))
                    offset += len(data)
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE_NAMES, r, strict=True)) for r in rows], schema=_CAPTURE_ARROW)
        if out is not None:
            out.close()

    return run


_CAPTURE_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_CAPTURE_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in CAPTURES.split(", ")])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of ``pages`` in ``folder``; the captures (CAPTURES), as a table."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("nth", F.monotonically_increasing_id())
    again = d.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct("page_id", "nth", "url")).alias("f"))
    again = again.where("c > 1").select("digest", F.col("f.page_id").alias("first"), F.col("f.nth").alias("first_nth"), F.col("f.url").alias("first_url"))
    again = shared.table(again, "warc-again")
    return shared.table(d.join(again, "digest", "left").mapInArrow(_write(folder), CAPTURES), "warc-captures")


def _index(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared.file_system(folder)
        name, out, directory, offset, block = "", None, [], 0, []

        def flush() -> None:
            nonlocal name, out, offset
            if out is None:
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            out.write(data)
            directory.append([block[0][0], block[0][1], offset, len(data)])
            offset += len(data)
            block.clear()

        for b in batches:
            for key, page, *rest in zip(*(c.to_pylist() for c in shared.columns(b, *_CAPTURE_NAMES)), strict=True):
                block.append([key, -1 if page is None else page, *rest])
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + len(data).to_bytes(8, "big") + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], names=["key", "page_id", "file"])

    return run


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Index files in ``folder``; the list of the level above: first key, first page_id, file."""
    ranged = captures.select("*", F.coalesce("page_id", F.lit(-1)).alias("at")).repartitionByRange("key", "at").sortWithinPartitions("key", "at").drop("at")
    made = shared.table(ranged.mapInArrow(_index(folder, lines), "key string, page_id long, file string"), "warc-index")
    return sorted(tuple(r) for r in made.collect())  # a row for each range


class CaptureIndex:
    """Lookups by binary search; keeps a few directories and blocks."""

    def __init__(self, top: list[tuple[str, int, str]], folder: str, archives: str, kept: int = 64):
        self.top, self.kept = top, kept
        self.fs, self.path = shared.file_system(folder)
        self.archives = shared.file_system(archives)[1]
        self.cache: OrderedDict = OrderedDict()

    def _cached(self, key, make):
        if key not in self.cache:
            self.cache[key] = make()
            if len(self.cache) > self.kept:
                self.cache.popitem(last=False)
        self.cache.move_to_end(key)
        return self.cache[key]

    def _directory(self, file: str) -> list[list]:
        with self.fs.open_input_file(f"{self.path}/{file}") as f:
            size = f.size()
            tail = f.read_at(16, size - 16)
            if tail[8:] != _MAGIC:
                raise ValueError(f"{file} has no directory")
            n = int.from_bytes(tail[:8], "big")
            return json.loads(zlib.decompress(f.read_at(n, size - 16 - n)))

    def _block(self, file: str, offset: int, length: int) -> list[list]:
        with self.fs.open_input_file(f"{self.path}/{file}") as f:
            return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]

    def find(self, uri: str, page_id: int) -> list | None:
        """The capture of a page at a target, or None."""
        want = (host_key(uri), page_id)
        i = bisect.bisect_right(self.top, want, key=lambda t: (t[0], t[1])) - 1
        if i < 0:
            return None
        file = self.top[i][2]
        directory = self._cached(file, lambda: self._directory(file))
        _, _, offset, length = directory[bisect.bisect_right(directory, want, key=lambda t: (t[0], t[1])) - 1]
        block = self._cached((file, offset), lambda: self._block(file, offset, length))
        j = bisect.bisect_left(block, want, key=lambda t: (t[0], t[1]))
        return block[j] if j < len(block) and tuple(block[j][:2]) == want else None

    def read(self, capture: list) -> tuple[dict[str, str], bytes]:
        """Headers and payload of a capture's record, by one range read."""
        *_, file, offset, length = capture
        with self.fs.open_input_file(f"{self.archives}/{file}") as f:
            return decode_record(zlib.decompress(f.read_at(length, offset), 31))


def _read(files, top, index_folder: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared.file_system(folder)
        index = CaptureIndex(top.value, index_folder, folder)
        known: OrderedDict[int, tuple[int, str]] = OrderedDict()

        def original(page: int, uri: str) -> tuple[int, str]:
            if page not in known:
                payload = index.read(index.find(uri, page))[1]
                known[page] = (len(payload), hashlib.sha256(payload).hexdigest())
                if len(known) > 10_000:
                    known.popitem(last=False)
            return known[page]

        for b in batches:
            for i in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{files.value[i]}", compression=None) as stream:
                    for data in members(stream):
                        h, payload = decode_record(data)
                        page = int(h["X-Page-Id"]) if "X-Page-Id" in h else None
                        refers = None
                        if h["WARC-Type"] == "revisit":
                            refers = int(h["X-Refers-To-Page-Id"])
                            n, digest = original(refers, h["WARC-Refers-To-Target-URI"])
                        else:
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if h["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"page {page}: the payload doesn't match its digest")
                        rows.append((page, n, digest, h["WARC-Type"], refers))
                        if len(rows) == 10_000:
                            yield _result(rows)
                            rows = []
                yield _result(rows)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def read(spark: SparkSession, captures: DataFrame, top: list, index_folder: str, folder: str) -> DataFrame:
    """A row (RESULT) for each record of the listed archives, one task an archive."""
    files = sorted(r[0] for r in captures.select("file").distinct().collect())  # one for each task that wrote
    if not files:
        return spark.createDataFrame([], RESULT)
    sc = spark.sparkContext
    return spark.range(0, len(files), 1, len(files)).mapInArrow(_read(sc.broadcast(files), sc.broadcast(top), index_folder, folder), RESULT)


def archive_and_read(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    base = shared.fresh_path(spark, "warc")
    shared.make_dirs(spark, f"{base}/archives", f"{base}/index")
    captures = write(pages, f"{base}/archives")
    top = build_index(captures, f"{base}/index")
    return read(spark, captures, top, f"{base}/index", f"{base}/archives")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY d)
SELECT page_id, strlen(html) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
