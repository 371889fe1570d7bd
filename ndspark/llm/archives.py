"""Web archive records in ZIP packages, read by range.

Writer: records (response, or revisit of an equal payload) are compressed one by one into a
``.warc.gz`` member; it and a line index (page id, offset, length) are *stored* members of a ZIP
package, so that a record is reached by its offset without extracting anything. Reader: finds the
end-of-central-directory record (and the ZIP64 one where sizes need it), walks the central
directory, resolves a stored member's data offset from its local header, reads the index, and
range-reads each record.

Packages of bounded size are files in a shared folder (any store that Arrow opens by URI); a table (path,
size) names those of the tasks that succeeded, so a task that ran twice adds nothing. ``read_file`` reads a
package from any seekable file. Length and SHA-256 of each payload are computed anew when it is read; a
difference raises. A revisit has no payload: its length and digest are those of its record.

Edge cases: a null page is an empty payload; payloads under ``least_bytes`` are never revisits; of
rows with equal payloads that repeat the smallest id too, each is a response; rows with a null id
are responses of their own; an empty table makes no package and gives no record; a record is never
split, so one page larger than ``package_bytes`` makes a package of its own.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import seal, sized

LEAST_BYTES = 100
PACKAGE_BYTES = 4 << 20
DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"

# Signatures and sentinels of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP, stored members only -------------------------------------------------------------


class StoredZip:
    """Writes stored members; ``zip64`` forces the 64-bit structures, else they are used where needed."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.at, self.zip64, self.central = out, 0, zip64, []

    def _put(self, *parts: bytes) -> None:
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def add(self, name: str, data: bytes) -> None:
        raw, start, crc, n = name.encode(), self.at, zlib.crc32(data), len(data)
        big = self.zip64 or n >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        short = MAX32 if big else n
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)), raw, extra, data)
        far = self.zip64 or start >= MAX32
        extra = (struct.pack("<QQ", n, n) if big else b"") + (struct.pack("<Q", start) if far else b"")
        extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
        self.central.append(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45 if big or far else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, MAX32 if far else start) + raw + extra)

    def close(self) -> None:
        start, n = self.at, len(self.central)
        self._put(*self.central)
        size = self.at - start
        if self.zip64 or n >= MAX16 or start >= MAX32 or size >= MAX32:
            where = self.at
            self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, start), struct.pack("<4sIQI", LOCATOR64, 0, where, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(struct.pack("<4s4H2IH", END, 0, 0, n, n, size, start, 0))


class ZipRanges:
    """Locates members of a package; ``read_at(offset, length)`` is the only access to its bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        back = min(size, 22 + MAX16)
        tail = read_at(size - back, back)
        i = tail.rfind(END)
        while i >= 0 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] > len(tail):
            i = tail.rfind(END, 0, i)
        if i < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<4H2I", tail, i + 4)[3:6]
        end = size - back + i
        if MAX16 == count or MAX32 in (length, start):
            signature, _, where, _ = struct.unpack("<4sIQI", read_at(end - 20, 20)) if end >= 20 else (b"", 0, 0, 0)
            if signature == LOCATOR64:
                record = read_at(where, 56)
                if record[:4] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                count, length, start = struct.unpack_from("<3Q", record, 32)
        directory, self.members, p = read_at(start, length), {}, 0
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL:
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<2H", directory, p + 8)
            packed, plain, n, m, k = struct.unpack_from("<2I3H", directory, p + 20)
            offset = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + n : p + 46 + n + m], 0
            while q + 4 <= len(extra):
                tag, width = struct.unpack_from("<2H", extra, q)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                    plain = wide.pop(0) if plain == MAX32 else plain
                    packed = wide.pop(0) if packed == MAX32 else packed
                    offset = wide.pop(0) if offset == MAX32 else offset
                q += 4 + width
            self.members[name] = (method, packed, offset)
            p += 46 + n + m + k

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data."""
        method, length, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: it can't be read by range")
        header = self.read_at(offset, 30)
        if header[:4] != LOCAL:
            raise ValueError("bad local header")
        n, m = struct.unpack_from("<2H", header, 26)
        return offset + 30 + n + m, length

    def read(self, name: str) -> bytes:
        return self.read_at(*self.locate(name))


# ---- WARC records -------------------------------------------------------------------------


def _record(row: dict, payload: bytes) -> bytes:
    """A compressed record: WARC fields, then an HTTP head and the payload; a revisit keeps the head only."""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    body = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"),
        ("WARC-Target-URI", (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of a compressed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def package(rows: Iterable[tuple[dict, bytes]], limit: int = PACKAGE_BYTES, zip64: bool = False) -> Iterator[bytes]:
    """Packages of about ``limit`` bytes, in the order of the rows."""
    data, index = [], []

    def close() -> bytes:
        out = io.BytesIO()
        z = StoredZip(out, zip64)
        z.add(DATA, b"".join(data))
        z.add(INDEX, "".join(json.dumps(x) + "\n" for x in index).encode())
        z.add(MANIFEST, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
        z.close()
        return out.getvalue()

    at = 0
    for row, payload in rows:
        record = _record(row, payload)
        if at and at + len(record) > limit:
            yield close()
            data, index, at = [], [], 0
        index.append({"id": row["page_id"], "offset": at, "length": len(record)})
        data.append(record)
        at += len(record)
    if index:
        yield close()


def read_package(read_at: Callable[[int, int], bytes], size: int, ids: set | None = None) -> Iterator[dict]:
    """The records of a package (of ``ids`` only, if given), each by one range read."""
    ranges = ZipRanges(read_at, size)
    start, length = ranges.locate(DATA)
    for line in ranges.read(INDEX).splitlines():
        entry = json.loads(line)
        if ids is not None and entry["id"] not in ids:
            continue
        if entry["offset"] + entry["length"] > length:
            raise ValueError("index points outside the archive")
        fields, http, payload = parse_record(read_at(start + entry["offset"], entry["length"]))
        refers = fields.get("WARC-Refers-To")
        declared = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r")[0])
        digest = fields["WARC-Payload-Digest"].partition(":")[2]
        if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (declared, digest):
            raise ValueError(f"the payload of record {entry['id']} is not the one that was written")
        yield {
            "page_id": entry["id"],
            "url": fields["WARC-Target-URI"],
            "record_type": fields["WARC-Type"],
            "payload_digest": digest,
            "payload_bytes": declared,
            "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
            "payload": payload if fields["WARC-Type"] == "response" else None,
        }


def read_file(file: BinaryIO, ids: set | None = None) -> Iterator[dict]:
    """Records of a package in a seekable file; only directories, the index and the records asked for are read."""

    def read_at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    file.seek(0, io.SEEK_END)
    return read_package(read_at, file.tell(), ids)


# ---- DataFrames ---------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every row.

    Only digests that occur for more than one id are joined back, so the payloads are not shuffled
    while that table has a size that may be broadcast.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    again = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
    again = again.where("first_id < last_id").select("payload_digest", "first_id")
    rows = rows.join(sized(seal(again)), "payload_digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _opened(uri: str) -> tuple[FileSystem, str]:
    """The store of a URI and the path in it; Hadoop's short form file:/path is a local one too."""
    return FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of each partition's records into ``folder``; (path, size) of each. Materialise the result once, as each run writes anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, bytes]]:
            for batch in batches:
                slim = batch.drop_columns(["payload"]).to_pylist()
                yield from zip(slim, (x.as_py() for x in batch.column("payload")))

        store, root = _opened(folder)
        for content in package(rows(), package_bytes):
            store.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(content)], pa.int64())], ["path", "size"])

    return records.mapInArrow(run, "path string, size long")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) from (path, size); payload is null for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _opened(path)
                with store.open_input_file(at) as file:
                    found: list[dict] = []
                    for record in read_file(file):
                        found.append(record)
                        if len(found) == 100:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    # packages are units of work: dealt out evenly, as a folder of few small rows would be one task
    width = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(width).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
