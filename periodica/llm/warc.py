"""WARC 1.1 archives with a two-level capture index.

Writing: payload digests decide which record is the response of a payload (the largest page_id) and which
revisit it; records are written as gzip members, one after another, so that each can be read by its own range.
Index: captures are sorted by their reversed-host URL key and cut into compressed blocks; a sparse directory
holds the first key of each block. A lookup binary-searches the directory, then the block, and reads ranges
of the archives.
Lookups of a whole table of urls take the same two steps, each in tasks of its own: an index file is found by
binary search among the files' first keys, a block of it among the file's blocks, a capture within the block.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm.common import drop_stage, new_dir, write_stage
from periodica.llm.shared_files import new_file, open_file

#: Captures in a block of the index, and bytes of an archive file before the next begins.
BLOCK_CAPTURES, FILE_BYTES = 1000, 256 << 20
#: Blocks of an index file on average where there are many, so that files stay few; and archive bytes that a reading task gets.
FILE_BLOCKS, TASK_BYTES = 1000, 64 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
#: Archives carry the time of capture; the tables have none, so all records carry one.
DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def url_key(url: str | None) -> str:
    """Reversed-host key: `http://www.b.org:80/P?q` gives `org,b)/p?q`. Urls without :// are their own key, lower-cased."""
    u = (url or "").strip()
    m = re.match(r"[^:/?#]+://([^/?#]*)([^#]*)", u, re.S)
    if not m:
        return u.lower()
    host = m[1].rpartition("@")[2].lower()
    host = re.sub(r":(80|443)?$", "", host)
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def _line(text: str | None) -> str:
    """A header value: no line breaks."""
    return re.sub(r"[\r\n]+", " ", text or "")


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit (refers_to given) has the HTTP head of the response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers by lower-case name, HTTP head, payload). Raises ValueError for what isn't a whole record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, http, payload


def pack_record(record: bytes) -> bytes:
    """One gzip member, without a time, so that equal records have equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as g:
        g.write(record)
    return out.getvalue()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html = b.column("html")
        payloads = ((html[i].as_py() or "").encode("utf-8", "surrogatepass") for i in range(b.num_rows))
        found = [(digest_of(p), len(p)) for p in payloads]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([d for d, _ in found]), pa.array([n for _, n in found], pa.int64())], names=["page_id", "digest", "bytes"])


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                ids, refs, digests = (b.column(c).to_pylist() for c in ("page_id", "refers_to", "digest"))
                urls, html = b.column("url"), b.column("html")
                for i in range(b.num_rows):
                    payload = (html[i].as_py() or "").encode("utf-8", "surrogatepass")
                    digest = digest_of(payload)
                    yield ids[i], urls[i].as_py(), payload, digest, refs[i] if digest == digests[i] else None

        it = rows()
        row = next(it, None)
        while row:
            index = []
            with new_file(folder, "pages.warc.gz") as (out, name):
                info = "software: periodica\r\nformat: WARC File Format 1.1\r\n"
                first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"
                at = out.write(head := pack_record(first.encode())) or len(head)
                while row and at < file_bytes:
                    member = pack_record(make_record(*row))
                    out.write(member)
                    index.append((url_key(row[1]), row[0], name, at, len(member)))
                    at += len(member)
                    row = next(it, None)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in index]), pa.array([x[1] for x in index], pa.int64()), pa.array([x[2] for x in index]), pa.array([x[3] for x in index], pa.int64()), pa.array([x[4] for x in index], pa.int64())], names=["key", "page_id", "file", "offset", "size"])

    return run


_CAPTURES = "key string, page_id long, file string, offset long, size long"


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to: of records with equal payloads of least_bytes at least, that with the largest page_id is the response."""
    found = write_stage(pages.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, bytes long"), "warc-digests")
    copies = found.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = found.groupBy("page_id").agg(F.max(F.struct("digest", "bytes")).alias("x")).select("page_id", "x.*")
    return found.join(copies, ["digest", "bytes"], "left").select("page_id", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives below folder; returns the captures: key, page_id, file, offset, size.

    pages needs page_id (unique, not null), url and html; other columns are ignored. A null html is an empty
    payload, and a null url an empty one. Rows without page_id are left out. Repeated rows are written each; of rows
    with one page_id but several payloads, those that the decision wasn't made for are responses. An empty table
    writes no archive.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").where("page_id is not null")
    dealt = pages.join(decide(pages, least_bytes), "page_id").select("page_id", "url", "html", "digest", "refers_to")
    return write_stage(dealt.mapInArrow(_write(folder, file_bytes), _CAPTURES), "warc-captures")


def _blocks(folder: str, captures: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "size")), strict=True)

        it = rows()
        row = next(it, None)
        if row is None:
            return
        out_rows = []
        with new_file(folder, "captures.cdx.gz") as (out, name):
            at = 0
            while row:
                lines, first, data = [], row, 0
                while row and len(lines) < captures:
                    lines.append(f"{json.dumps(row[0])} {json.dumps({'page_id': row[1], 'file': row[2], 'offset': row[3], 'size': row[4]})}\n")
                    data += row[4]
                    row = next(it, None)
                block = zlib.compress("".join(lines).encode("utf-8", "surrogatepass"), 6)
                out.write(block)
                out_rows.append((first[0], first[1], name, at, len(block), len(lines), data))
                at += len(block)
        names = ["key", "page_id", "block_file", "offset", "size", "captures", "bytes"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out_rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def build_index(captures: DataFrame, folder: str, captures_per_block: int = BLOCK_CAPTURES) -> DataFrame:
    """The block directory: first key and page_id of each block, its file, offset, size, number of captures and their bytes in the archives.

    Captures are sorted by (key, page_id) over range partitions, each of which writes an index file; equal keys, of a
    very common url too, may run on over blocks and files, since page_id breaks the tie.
    """
    blocks = -(-captures.count() // captures_per_block)
    files = max(1, -(-blocks // FILE_BLOCKS), min(blocks, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = captures.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")
    return write_stage(ordered.mapInArrow(_blocks(folder, captures_per_block), "key string, page_id long, block_file string, offset long, size long, captures long, bytes long"), "warc-directory")


def read_block(folder: str, name: str, offset: int, size: int) -> list[tuple[str, dict]]:
    f = open_file(folder, name)
    try:
        lines = zlib.decompress(f.read_at(size, offset)).decode("utf-8", "surrogatepass").splitlines()
    finally:
        f.close()
    decoder = json.JSONDecoder()
    out = []
    for x in lines:
        key, end = decoder.raw_decode(x)
        out.append((key, json.loads(x[end:])))
    return out


def read_capture(folder: str, capture: dict) -> tuple[dict[str, str], bytes, bytes]:
    """One record by a range read of its archive."""
    f = open_file(folder, capture["file"])
    try:
        return parse_record(gzip.decompress(f.read_at(capture["size"], capture["offset"])))
    finally:
        f.close()


class Lookup:
    """Finds the captures of a url: binary search in the sparse directory, then in the block.

    The directory has one entry for BLOCK_CAPTURES captures; rows: (key, page_id, block_file, offset, size) in order.
    """

    def __init__(self, folder: str, directory: list[tuple]):
        self.folder, self.directory = folder, sorted(directory, key=lambda r: (r[0], r[1]))
        self.keys = [r[0] for r in self.directory]

    def captures(self, url: str) -> list[dict]:
        key, out = url_key(url), []
        at = max(0, bisect.bisect_left(self.keys, key) - 1)  # captures of the key may begin in the block before
        while at < len(self.directory) and self.keys[at] <= key:
            _, _, name, offset, size = self.directory[at][:5]
            block = read_block(self.folder, name, offset, size)
            i = bisect.bisect_left(block, key, key=lambda x: x[0])
            while i < len(block) and block[i][0] == key:
                out.append(block[i][1])
                i += 1
            at += 1
        return out

    def read(self, url: str) -> list[tuple[dict[str, str], bytes, bytes]]:
        return [read_capture(self.folder, c) for c in self.captures(url)]


def _record(file, capture: dict) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a capture, by a range read; ValueError where a payload doesn't have its digest."""
    headers, http, payload = parse_record(gzip.decompress(file.read_at(capture["size"], capture["offset"])))
    revisit = headers["warc-type"] == "revisit"
    # a revisit's HTTP head is that of the full response
    length = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1]) if revisit else len(payload)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest_of(payload) != digest:
        raise ValueError(f"payload of page {headers['x-page-id']} doesn't have its digest")
    return int(headers["x-page-id"]), headers["warc-target-uri"], length, digest, headers["warc-type"], int(headers["x-refers-to-page-id"]) if revisit else None


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(folder: str, captures: list[dict]) -> pa.RecordBatch:
    files, out = {}, []
    for c in sorted(captures, key=lambda c: (c["file"], c["offset"])):
        if c["file"] not in files:
            files[c["file"]] = open_file(folder, c["file"])
        out.append(_record(files[c["file"]], c))
    for f in files.values():
        f.close()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, offset, size in zip(*(b.column(c).to_pylist() for c in ("block_file", "offset", "size")), strict=True):
                yield _records(folder, [c for _, c in read_block(folder, name, offset, size)])

    return run


def _reading_tasks(directory: DataFrame) -> int:
    """How many tasks read the archives: by their bytes, but as many as are configured where there are blocks enough."""
    r = directory.agg(F.count("*"), F.sum("bytes")).first()
    return max(1, -(-(r[1] or 0) // TASK_BYTES), min(r[0], int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every capture, by the index's blocks and range reads."""
    blocks = directory.select("block_file", "offset", "size").repartition(_reading_tasks(directory), "block_file", "offset")
    return blocks.mapInArrow(_read(folder), RECORDS)


def covering(firsts: list[tuple], wanted: tuple) -> range:
    """Places, in a sorted list of first entries, of the runs that may hold `wanted`: the last that begins before it, and those that begin with it."""
    return range(max(0, bisect.bisect_left(firsts, wanted) - 1), bisect.bisect_right(firsts, wanted))


def _route(firsts: list[tuple], names: list[str]):
    """To each wanted capture, by binary search, the index files that may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, files = [], [], []
            for url, page in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                key = url_key(url)
                for at in covering(firsts, (key, page)):
                    keys.append(key), ids.append(page), files.append(names[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(files, pa.string())], names=["key", "page_id", "block_file"])

    return run


def _find_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """To each wanted capture of an index file, by binary search in its directory, the blocks that may hold it."""
    right = right.sort_by([("key", "ascending"), ("page_id", "ascending"), ("offset", "ascending")])
    firsts = list(zip(right.column("key").to_pylist(), right.column("page_id").to_pylist(), strict=True))
    rows, at = [], []
    for i, w in enumerate(zip(left.column("key").to_pylist(), left.column("page_id").to_pylist(), strict=True)):
        for k in covering(firsts, w):
            rows.append(i), at.append(k)
    rows, at = pa.array(rows, pa.int64()), pa.array(at, pa.int64())
    cols = [left.column("key").take(rows), left.column("page_id").take(rows), *(right.column(c).take(at) for c in ("block_file", "offset", "size"))]
    return pa.table(dict(zip(("key", "page_id", "block_file", "offset", "size"), cols, strict=True)))


def _fetch(folder: str):
    """Rows come ordered by block; each block is read once, searched, and its captures read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts, block, hits = None, [], [], []
        for b in batches:
            for key, page, *where in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "block_file", "offset", "size")), strict=True):
                if where != now:
                    if hits:
                        yield _records(folder, hits)
                    now, block, hits = where, read_block(folder, *where), []
                    firsts = [(k, c["page_id"]) for k, c in block]
                i = bisect.bisect_left(firsts, (key, page))
                while i < len(block) and firsts[i] == (key, page):
                    hits.append(block[i][1])
                    i += 1
        if hits:
            yield _records(folder, hits)

    return run


def look_up(directory: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records (columns as of read_archives) of the wanted captures, given by url and page_id, by binary searches and range reads.

    Repeated rows of `wanted` count once; captures of one url and page_id come each. What isn't there gives no row. The
    first keys of the index files, one for a million captures where there are many, go to every task.
    """
    spark = directory.sparkSession
    top = directory.groupBy("block_file").agg(F.min(F.struct("key", "page_id")).alias("f")).orderBy("f").collect()
    firsts, names = [(r.f.key, r.f.page_id) for r in top], [r.block_file for r in top]
    routed = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).where("page_id is not null").distinct().mapInArrow(_route(firsts, names), "key string, page_id long, block_file string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file's lookups are dealt over several groups; its directory is small and goes to each of them
    groups = max(1, min(16, parts // max(1, len(names))))
    deal: Column = F.pmod(F.xxhash64("page_id"), F.lit(groups)).cast("int")
    asked = routed.withColumn("g", deal).groupBy("block_file", "g")
    known = directory.select("block_file", "key", "page_id", "offset", "size").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("block_file", "g")
    placed = asked.cogroup(known).applyInArrow(_find_blocks, "key string, page_id long, block_file string, offset long, size long")
    dealt = placed.repartition(_reading_tasks(directory), "block_file", "offset").sortWithinPartitions("block_file", "offset", "key", "page_id")
    return dealt.mapInArrow(_fetch(folder), RECORDS)


def roundtrip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives and their index to the shared folder, then look every page's captures up in the index and read them back.

    Null keys, repeated rows and empty tables as in write_archives: a page_id's captures come once each.
    """
    folder = new_dir(spark, "warc")
    captures = write_archives(pages, folder, least_bytes)
    directory = build_index(captures, folder)
    drop_stage(captures)
    return look_up(directory, folder, pages)
