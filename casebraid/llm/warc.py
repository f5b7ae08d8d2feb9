"""WARC archives with a two-level capture index (operator 2).

write_archives() writes a gzip member for each page; of equal payloads one record is a response and the
others revisit it. build_index() sorts the captures by their key (the host's labels in reverse, then the
path) over range partitions and writes them as compressed blocks, with a sparse directory of the blocks'
first keys. lookup() finds a key's blocks by binary search in the directory, reads just these, and
searches in them by binary search again; read_records() then reads just the records' bytes. Files are written and read through
pyarrow's file systems in the shared folder. A task that runs again writes new files; only those of the
attempt that succeeded are in the index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file is closed after so many bytes; a block holds so many captures; a directory slice so many blocks.
FILE_BYTES, BLOCK_LINES, SLICE_BLOCKS = 64 << 20, 512, 500_000
CAPTURES = "key string, page_id long, url string, file string, start long, length long, digest string, type string"
DIRECTORY = "first string, file string, start long, length long, captures long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"
_URI = "urn:page:"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}")


def url_key(url: str | None) -> str:
    """com,example,www)/path?query in lower case (host only), without scheme, user, port and fragment; null gives an empty key."""
    found = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not found:
        return url or ""
    host = found[1].rpartition("@")[2].partition(":")[0].lower()
    return f"{','.join(reversed(host.split('.')))}){found[2] or '/'}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, as a gzip member. A revisit has no payload."""
    name = lambda i: f"<{_URI}{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple:
    """page_id, url, record type, payload digest, refers_to and payload (None of a revisit) of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    number = lambda v: None if v is None or v == f"<{_URI}none>" else int(v[len(_URI) + 1 : -1])
    url = fields.get("WARC-Target-URI")
    url = None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    return number(fields["WARC-Record-ID"]), url, fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), number(fields.get("WARC-Refers-To")), payload


class _Files:
    """Files of one task attempt, of about FILE_BYTES each."""

    def __init__(self, root: str, prefix: str, suffix: str):
        self.system, self.root = _system(root)
        self.system.create_dir(self.root, recursive=True)
        self.prefix, self.suffix = prefix, suffix
        self.out, self.at, self.name = None, 0, ""

    def put(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{self.prefix}-{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)  # by its name it would compress again
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _rows(batch_rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*batch_rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) to root and returns the captures. Each evaluation writes anew: save the result.

    Null html is the empty payload. Of records with equal payloads of least_bytes or more, that with the largest page_id
    is the response (all of them, if it repeats) and the others revisit it; rows without page_id are always responses.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload")))
    heads = rows.where(F.octet_length("payload") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("same", "head")
    marked = rows.join(heads, "same", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to"))

    def run(batches):
        files = _Files(root, "pages", ".warc.gz")
        try:
            for batch in batches:
                out = []
                for page, url, body, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    digest = sha1_base32(body)
                    member = record(page, url, body, digest, head, date)
                    file, start = files.put(member)
                    out.append((url_key(url), page, url, file, start, len(member), digest, "response" if head is None else "revisit"))
                yield _rows(out, CAPTURES)
        finally:
            files.close()

    return marked.mapInArrow(run, CAPTURES)


def build_index(captures: DataFrame, root: str) -> DataFrame:
    """Writes the sorted captures as compressed blocks to root and returns their directory. Save the result."""

    def run(batches):
        files = _Files(root, "index", ".cdx.gz")
        lines: list[list] = []

        def block() -> tuple:
            data = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 6, mtime=0)
            file, start = files.put(data)
            return lines[0][0], file, start, len(data), len(lines)

        try:
            for batch in batches:
                out = []
                for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                    lines.append(list(row))
                    if len(lines) == BLOCK_LINES:
                        out.append(block())
                        lines = []
                yield _rows(out, DIRECTORY)
            if lines:
                yield _rows([block()], DIRECTORY)
        finally:
            files.close()

    return captures.repartitionByRange("key", "page_id", "file", "start").sortWithinPartitions("key", "page_id", "file", "start").mapInArrow(run, DIRECTORY)


def _read(system: fs.FileSystem, handles: dict, path: str, start: int, length: int) -> bytes:
    if path not in handles:
        for other in handles.values():
            other.close()
        handles.clear()
        handles[path] = system.open_input_file(path)
    return handles[path].read_at(length, start)


def all_captures(directory: DataFrame, root: str) -> DataFrame:
    """Every capture, read from the blocks."""

    def run(batches):
        system, base = _system(root)
        handles: dict = {}
        for batch in batches:
            for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                yield _rows([tuple(json.loads(x)) for x in gzip.decompress(_read(system, handles, f"{base}/{file}", start, length)).decode().split("\n")], CAPTURES)

    return directory.mapInArrow(run, CAPTURES)


def _keys(urls: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(run, "key string").distinct()


BLOCKS = "key string, file string, start long, length long"


def lookup(urls: DataFrame, directory: DataFrame, root: str, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """urls (url; null has the empty key) to the captures of their keys, each once.

    Each key is sought by binary search in the sparse directory, which is broadcast in slices of bounded size, by ranges
    of keys. The blocks found are dealt out, so a key of very many captures is read by many tasks; each block is read
    once, by its range, and searched for all its keys.
    """
    spark = urls.sparkSession
    cuts = [None]
    blocks = directory.count()
    n = -(-blocks // slice_blocks)
    if n > 1:
        cuts += sorted({r[0] for r in directory.select("first").sample(fraction=min(1.0, 20 * n / blocks), seed=1).collect()})[:: max(1, 20)]
    found = spark.createDataFrame([], BLOCKS)
    keys = _keys(urls)
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        part = directory
        part = part if low is None else part.where(F.col("first") >= low)
        part = part if high is None else part.where(F.col("first") < high)
        rows = sorted(tuple(r) for r in part.select("first", "file", "start", "length").collect())
        if low is not None:  # the block before may reach into this range
            before = directory.where(F.col("first") < low).orderBy(F.col("first").desc()).limit(1).select("first", "file", "start", "length").collect()
            rows = sorted([*(tuple(r) for r in before), *rows])
        held = spark.sparkContext.broadcast(rows)

        def seek(batches, held=held, low=low, high=high):
            blocks = held.value
            firsts = [b[0] for b in blocks]
            for batch in batches:
                out = []
                for key in batch.column("key").to_pylist():
                    if low is not None and key < low or high is not None and key >= high:
                        continue
                    at = max(0, bisect.bisect_left(firsts, key) - 1)
                    while at < len(blocks) and firsts[at] <= key:
                        out.append((key, *blocks[at][1:]))
                        at += 1
                yield _rows(out, BLOCKS)

        found = found.unionByName(keys.mapInArrow(seek, BLOCKS))

    def read(batches):
        system, base = _system(root)
        handles: dict = {}
        block, lines = None, []
        for batch in batches:
            out = []
            for key, *place in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "start", "length")), strict=True):
                if place != block:
                    block, lines = place, [json.loads(x) for x in gzip.decompress(_read(system, handles, f"{base}/{place[0]}", *place[1:])).decode().split("\n")]
                k = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while k < len(lines) and lines[k][0] == key:
                    out.append(tuple(lines[k]))
                    k += 1
            yield _rows(out, CAPTURES)

    dealt = (found.distinct() if n > 1 else found).repartition("file", "start").sortWithinPartitions("file", "start", "key")
    return dealt.mapInArrow(read, CAPTURES)


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """The records of captures, each by a range read; a payload that does not match its digest is an error."""

    def run(batches):
        system, base = _system(root)
        handles: dict = {}
        for batch in batches:
            out, held = [], 0
            for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                page, url, kind, digest, refers, payload = parse(_read(system, handles, f"{base}/{file}", start, length))
                if payload is not None and sha1_base32(payload) != digest:
                    raise ValueError(f"payload of page {page} does not match its digest")
                out.append((page, url, kind, digest, refers, payload))
                held += len(payload or b"")
                if held > 4 << 20 or len(out) == 500:
                    yield _rows(out, RECORDS)
                    out, held = [], 0
            yield _rows(out, RECORDS)

    return captures.select("file", "start", "length").repartition("file").sortWithinPartitions("file", "start").mapInArrow(run, RECORDS)


def summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the size of the payload it refers to."""
    told = records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    sizes = told.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("referred"))
    both = told.join(sizes, ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.coalesce("payload_bytes", "referred").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
