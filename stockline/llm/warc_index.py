"""WARC archives with a two-level capture index, and lookups through it.

Pages are laid out by (reversed-host URL key, page_id) over range partitions; each task writes one archive, one gzip
member per record, and next to it its part of the index: sorted lines (key, page_id, place of the record) in gzip blocks
of BLOCK_LINES lines, and a sparse directory with one line per block. A lookup finds the archive by binary search over
the archives' first keys, the block by binary search over that archive's directory, reads the block by its byte range,
finds the line by binary search, and reads the record by its byte range. Lookups are range-partitioned too, so a task
reads neighbouring blocks and records once each.

Of records with equal payloads of at least `min_bytes` bytes the one with the largest page_id is a response, the others
are revisits of it without a payload; all others are responses. Payloads are UTF-8, null html is empty.

Files go to a new folder below the shared folder of the session (spark.checkpoint.dir), under names that no other
attempt of a task uses; only the archives named by the finished tasks are read. Null url: the empty key and target.
Null page_id: a response that nothing refers to, first of its key. Repeated rows: a record each. Other columns are
ignored. White space and control characters in URLs are written %20.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm.common import ship_package, sliced
from stockline.operators.scale import checkpointed
from stockline.session import shared_folder

BLOCK_LINES = 1000
READ_AHEAD = 1 << 20  # bytes read at once from an archive
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # pages have no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)

_ARCHIVES = "archive string, first_key binary, first_id long, records long"
_RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long"
)


def plain_url(url: Column) -> Column:
    """The URL as it stands in record headers, where white space and control characters are written %20."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def url_key(url: Column) -> Column:
    """The reversed-host key: `com,example,www)/path?query`, without scheme, port, user and fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(host == "", url).otherwise(key)


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a URI."""
    jvm, name = spark.sparkContext._jvm, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    uri = files.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, key, payload, payload_bytes, payload_sha1 (hex), is_page, refers_to.

    Each page is a row with is_page. Where a page is a revisit, a row without payload for the same key, page_id and
    payload names its response. Payloads thus need not meet by digest: only narrow rows do, and a common payload is no
    hot key of wide rows.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), plain_url(F.col("url")).alias("url"), payload.alias("payload")
    ).select(
        "page_id", "url", url_key(F.col("url")).cast("binary").alias("key"), "payload",
        F.sha1("payload").alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    of_payload = ["payload_sha1", "payload_bytes"]
    known = rows.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    last = known.groupBy(*of_payload).agg(F.max("page_id").alias("refers_to"))
    marks = known.select("page_id", "key", *of_payload).distinct().join(last, of_payload)
    marks = marks.filter("refers_to <> page_id").withColumn("is_page", F.lit(False))
    names = ["page_id", "url", "key", "payload", *of_payload, "is_page", "refers_to"]
    whole = rows.withColumns({"is_page": F.lit(True), "refers_to": F.lit(None).cast("long")}).select(*names)
    return whole.unionByName(marks, allowMissingColumns=True)


def record_bytes(page_id: int | None, url: str, payload: bytes | None, size: int, sha1: str, refers: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> dict:
    """The columns of a record: digests and sizes from the payload for responses, from the headers for revisits."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) else None
    known = {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"]}
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if known["record_type"] == "revisit":
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        return known | {"payload": None, "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To")}
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if own != digest:
        raise ValueError(f"payload of {known['url']} does not match its digest")
    return known | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own, "refers_to": None}


def _packed(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _line(key: bytes, page: int, offset: int, size: int) -> bytes:
    return b"%s\t%d\t%d\t%d" % (key, page, offset, size)  # keys hold no tab, see plain_url


def _place(line: bytes) -> tuple[bytes, int]:
    key, page = line.split(b"\t")[:2]
    return key, int(page)


def written(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> tuple[str, DataFrame]:
    """Writes archives and index; (folder, one row for each archive: archive, first_key, first_id, records)."""
    folder = _folder(pages.sparkSession)
    ship_package(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in sliced(batches) for row in zip(*(c.to_pylist() for c in part.columns)))
        row = next(rows, None)
        if row is None:
            return
        files, path = _open(folder)
        name = uuid.uuid4().hex
        first, lines, sparse, offset, index_offset, records = None, [], [], 0, 0, 0
        with (
            files.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as archive,
            files.open_output_stream(f"{path}/{name}.idx.gz", compression=None) as index,
            files.open_output_stream(f"{path}/{name}.dir", compression=None) as directory,
        ):

            def flush() -> None:
                nonlocal index_offset
                block = _packed(b"\n".join(lines))
                sparse.append([*_place(lines[0]), index_offset, len(block)])
                index.write(block)
                index_offset += len(block)
                lines.clear()

            marks: dict[tuple, int] = {}  # of the pages at one place
            while row is not None:
                page_id, url, key, payload, sha1, size, is_page, refers = row
                if not is_page:
                    if marks and next(iter(marks))[:2] != (key, page_id):
                        marks.clear()
                    marks[key, page_id, sha1] = refers
                    row = next(rows, None)
                    continue
                refers = marks.get((key, page_id, sha1))
                data = _packed(record_bytes(page_id, url, payload if refers is None else None, size, sha1, refers))
                archive.write(data)
                place = _NO_ID if page_id is None else page_id
                first = first or (key, place)
                lines.append(_line(key, place, offset, len(data)))
                offset, records = offset + len(data), records + 1
                if len(lines) == block_lines:
                    flush()
                row = next(rows, None)
            if lines:
                flush()
            directory.write(json.dumps([[k.hex(), *rest] for k, *rest in sparse]).encode())
        columns = [[name], [first[0]], [first[1]], [records]]
        types = [pa.string(), pa.binary(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _ARCHIVES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    dealt = captures(pages, min_bytes).repartitionByRange("key", "page_id")
    laid = dealt.sortWithinPartitions("key", "page_id", "is_page")  # a page's mark comes before it
    # Written once: what is read below is this list of the finished tasks' archives.
    return folder, checkpointed(laid.mapInArrow(write, _ARCHIVES))


class Archive:
    """One archive with its directory; reads blocks and records by byte range."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, path = _open(folder)
        self.archive = self.files.open_input_file(f"{path}/{name}.warc.gz")
        self.index = self.files.open_input_file(f"{path}/{name}.idx.gz")
        with self.files.open_input_stream(f"{path}/{name}.dir", compression=None) as file:
            self.sparse = [(bytes.fromhex(key), page, *rest) for key, page, *rest in json.loads(file.read())]
        self.firsts = [block[:2] for block in self.sparse]
        self.block, self.lines, self.places = -1, [], []
        self.start, self.ahead = 0, b""

    def close(self) -> None:
        self.archive.close()
        self.index.close()

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, offset, size = self.sparse[block]
            self.lines = zlib.decompress(self.index.read_at(size, offset), 31).split(b"\n")
            self.block, self.places = block, [_place(line) for line in self.lines]

    def _record(self, offset: int, size: int) -> bytes:
        if not self.start <= offset <= offset + size <= self.start + len(self.ahead):
            self.start, self.ahead = offset, self.archive.read_at(max(size, READ_AHEAD), offset)
        at = offset - self.start
        return zlib.decompress(self.ahead[at : at + size], 31)

    def find(self, place: tuple[bytes, int]) -> Iterator[dict]:
        """The records at a (key, page_id), which may reach over several blocks."""
        block = max(0, bisect.bisect_left(self.firsts, place) - 1)
        while block < len(self.firsts) and self.firsts[block] <= place:
            self._load(block)
            i = bisect.bisect_left(self.places, place)
            while i < len(self.places) and self.places[i] == place:
                offset, size = map(int, self.lines[i].split(b"\t")[2:])
                yield parsed_record(self._record(offset, size))
                i += 1
            block += 1


def looked_up(wanted: DataFrame, folder: str, archives: DataFrame) -> DataFrame:
    """The records of distinct (url, page_id) rows of `wanted`; those that were never written give no row."""
    # One row per archive, of which there are as many as partitions were written.
    tops = sorted((bytes(r.first_key), r.first_id, r.archive) for r in archives.collect())
    firsts, names = [top[:2] for top in tops], [top[2] for top in tops]
    fields = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, archive = -1, None
        for part in sliced(batches):
            found = []
            for key, page_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                place = (key, _NO_ID if page_id is None else page_id)
                # Equal places may begin one archive earlier than the one that begins with them.
                near = max(0, bisect.bisect_left(firsts, place) - 1)
                while near < len(firsts) and firsts[near] <= place:
                    if near != at:
                        if archive is not None:
                            archive.close()
                        at, archive = near, Archive(folder, names[near])
                    found.extend(archive.find(place))
                    near += 1
            columns = [pa.array([row[f] for row in found], type=t) for f, t in zip(fields, types)]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    rows = wanted.select(
        url_key(plain_url(F.col("url"))).cast("binary").alias("key"), F.col("page_id").cast("long").alias("page_id")
    ).distinct()
    # As many tasks as archives: the rows are narrow, what they stand for is not.
    laid = rows.repartitionByRange(max(1, len(tops)), "key", "page_id").sortWithinPartitions("key", "page_id")
    ship_package(wanted.sparkSession)
    return laid.mapInArrow(read, _RECORDS)
