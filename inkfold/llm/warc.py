"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, one WARC/1.1 record each, to shared storage; a
payload that another page has too is written once, by the page with the largest id, and the others
become revisit records. Only archives that a task's committed capture rows name are ever read, so a
retried or lost task leaves at most an unused file.

Index: captures sorted by reversed-host key are packed into compressed blocks, a file per range of keys;
beside each such file lies its sparse directory (first key and byte range of each block). A manifest
names the files' first and last keys. A lookup bisects the manifest, then a directory, reads that byte
range, bisects the block, and reads the record's byte range from its archive. Many lookups at once are dealt by
index part and sorted, so that neighbouring keys find their block already read.

Storage is reached through pyarrow's file systems by URI, so the folder may be a mounted path or an
object store; input tables are read by Spark alone.
Defined results: a null html is an empty payload; a null url has an empty key and no target header; a
null page_id is kept, and is a revisit if any page with an id has the payload; rows that repeat, with
the payload's largest id, are all responses; an empty table gives an empty archive; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import fresh_path, hash_bits, hash_hits, materialize

CAPTURES = "surt string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_GAP = 4 << 20
#: Parts in which the pages of one repeated payload meet their holder.
_SALTS = 32
#: Archive bytes that one task reads back, and the most tasks that do so.
_READ, _READERS = 8 << 20, 20_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: com,example,www)/path?query. Without a host: the URL as it is."""
    if not url:
        return ""
    _, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].lower()
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:].partition("#")[0]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}"]
    if url:
        fields.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    fields += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}",
            f"X-Refers-To-Key: {json.dumps(surt(refers_url))}",
        ]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(raw: bytes) -> Record:
    """A record read back; raises ValueError if lengths or the payload digest do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    found = Record(fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload)
    if fields["WARC-Type"] == "response":
        if len(payload) != int(found.http["Content-Length"]) or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError("payload does not match its digest")
    return found


def _open(root: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(root)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, refers_url: the page whose payload a revisit repeats, else null. Only digests
    that repeat take part in the join; they are aggregated before it, without payloads. A payload that very many
    pages have is joined in ``_SALTS`` parts."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    repeated = (
        keyed.where(F.col("bytes") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.max_by("url", "page_id").alias("holder_url"), F.count("*").alias("n"))
        .where("n > 1 and holder is not null").drop("n")
    )
    repeated = materialize(repeated, "repeated")
    maybe, single = hash_hits(keyed, hash_bits(repeated, F.col("digest")), F.col("digest"))
    salts = repeated.select("digest", "holder", "holder_url", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    joined = maybe.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(salts, ["digest", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    alone = single.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"), F.col("holder_url").alias("refers_url")).union(alone)


def write_archives(decided: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z", level: int = 4, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write the records, a new archive after ``roll_bytes``; returns the captures (CAPTURES) that name where each one lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        task = TaskContext.get()
        stream, at, files, name, rows = None, 0, 0, "", []
        for batch in batches:
            for page, url, html, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                packer = zlib.compressobj(level, wbits=31)
                member = packer.compress(record(page, url, (html or "").encode(), refers, date, refers_url)) + packer.flush()
                if stream is None:
                    name, at = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz", 0
                    stream, files = fs.open_output_stream(f"{folder}/{name}", compression=None), files + 1
                stream.write(member)
                rows.append((surt(url), page, name, at, len(member)))
                at += len(member)
                if at >= roll_bytes:
                    stream.close()
                    yield _batch(rows)
                    stream, rows = None, []
        if stream is not None:
            # an archive is complete before its captures are handed on
            stream.close()
            yield _batch(rows)

    _make(root)
    return materialize(decided.mapInArrow(run, CAPTURES), "captures")


_CAPTURE_NAMES = ["surt", "page_id", "file", "offset", "length"]
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE_TYPES)], _CAPTURE_NAMES)


def _make(root: str) -> None:
    fs, folder = _open(root)
    fs.create_dir(folder, recursive=True)


def _line(row: tuple) -> bytes:
    return json.dumps(row, separators=(",", ":")).encode()


def write_index(captures: DataFrame, root: str, block_lines: int = 3000) -> DataFrame:
    """Write the capture index; returns its manifest: first and last key, file, lines and record bytes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        pending: list[tuple] = []
        directory: list[tuple] = []
        stream, at, last, lines, size = None, 0, "", 0, 0

        def flush() -> None:
            nonlocal stream, at
            packed = zlib.compress(b"\n".join(map(_line, pending)), 6)
            stream = stream or fs.open_output_stream(f"{folder}/{name}.cdx.z", compression=None)
            stream.write(packed)
            directory.append((pending[0][0], at, len(packed)))
            at += len(packed)
            pending.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(row)
                last, lines, size = row[0], lines + 1, size + row[4]
                if len(pending) == block_lines:
                    flush()
        if pending:
            flush()
        if stream:
            stream.close()
            with fs.open_output_stream(f"{folder}/{name}.dir", compression=None) as out:
                out.write(b"\n".join(map(_line, directory)))
            yield pa.record_batch([pa.array([directory[0][0]]), pa.array([last]), pa.array([name]), pa.array([lines]), pa.array([size])], ["first", "last", "name", "lines", "bytes"])

    _make(root)
    # page_id in the range key splits a key that very many captures share
    dealt = captures.select(*_CAPTURE_NAMES).repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return materialize(dealt.mapInArrow(run, "first string, last string, name string, lines long, bytes long"), "manifest")


def _key(row: tuple) -> str:
    return row[0]


class IndexPart:
    """One index file and its directory, read by byte ranges; the block read last is kept."""

    def __init__(self, root: str, name: str):
        self.held: tuple[int, list[tuple]] = (-1, [])
        self.fs, folder = _open(root)
        self.path = f"{folder}/{name}"
        with self.fs.open_input_file(f"{self.path}.dir") as f:
            self.directory = [tuple(json.loads(x)) for x in f.read().split(b"\n")]
        self.keys = [x[0] for x in self.directory]

    def block(self, k: int) -> list[tuple]:
        if self.held[0] != k:
            _, offset, length = self.directory[k]
            with self.fs.open_input_file(f"{self.path}.cdx.z") as f:
                f.seek(offset)
                self.held = k, [tuple(json.loads(x)) for x in zlib.decompress(f.read(length)).split(b"\n")]
        return self.held[1]

    def between(self, low: str | None, high: str | None) -> Iterator[tuple]:
        """Captures with low <= key <= high; only blocks that can hold one are read."""
        start = 0 if low is None else max(bisect_left(self.keys, low) - 1, 0)
        stop = len(self.keys) if high is None else bisect_right(self.keys, high)
        for k in range(start, stop):
            rows = self.block(k)
            yield from rows[0 if low is None else bisect_left(rows, low, key=_key) : len(rows) if high is None else bisect_right(rows, high, key=_key)]


@dataclass
class Archive:
    """Where the archives and their index lie. manifest: one row per index part, so bounded by the
    number of tasks that wrote it."""

    root: str
    index_root: str
    manifest: DataFrame

    def captures(self, url: str) -> list[tuple]:
        """Captures of one URL by bisecting manifest, directory and block."""
        return self.captures_of(surt(url))

    def captures_of(self, key: str) -> list[tuple]:
        parts = self.manifest.where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first", "name").collect()
        return [row for p in parts for row in IndexPart(self.index_root, p.name).between(key, key)]

    def read(self, file: str, offset: int, length: int) -> Record:
        fs, folder = _open(self.root)
        with fs.open_input_file(f"{folder}/{file}") as f:
            f.seek(offset)
            return parse(zlib.decompress(f.read(length), wbits=31))

    def fetch(self, url: str) -> list[Record]:
        """The records of a URL; a revisit has the payload of the response that it refers to, which is looked up by
        the key that the revisit names."""
        found = []
        for _, _, file, offset, length in self.captures(url):
            r = self.read(file, offset, length)
            if holder := r.fields.get("X-Refers-To-Page-ID"):
                for _, page, *spot in self.captures_of(json.loads(r.fields["X-Refers-To-Key"])):
                    if page == int(holder) and (response := self.read(*spot)).fields["WARC-Type"] == "response":
                        r.payload = response.payload
                        break
            found.append(r)
        return found

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The captures (CAPTURES) of every URL in the column url, each once: keys are dealt to the index parts whose
        range holds them, sorted, and found by bisecting directory and block. The manifest has a row for each task
        that wrote the index; all tasks hold it."""
        root = self.index_root
        parts = sorted((r["first"], r["last"], r["name"]) for r in self.manifest.select("first", "last", "name").collect())
        firsts = [p[0] for p in parts]
        # the largest last key up to each part: a key that many captures share runs through several parts
        reach = list(accumulate((p[1] for p in parts), max))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, names = [], []
                for url in batch.column(0).to_pylist():
                    key = surt(url)
                    for first, last, name in parts[bisect_left(reach, key) : bisect_right(firsts, key)]:
                        if first <= key <= last:
                            keys.append(key)
                            names.append(name)
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(names, pa.string())], ["key", "name"])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, name = None, None
            for batch in batches:
                rows = []
                for key, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                    if wanted != name:
                        part, name = IndexPart(root, wanted), wanted
                    for row in part.between(key, key):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

        dealt = urls.select("url").distinct().mapInArrow(deal, "key string, name string").distinct()
        return dealt.repartition(max(len(parts), 1), "name").sortWithinPartitions("name", "key").mapInArrow(find, CAPTURES)

    def all_captures(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """Captures of a key range (all of them by default), each index part read by one task."""
        root = self.index_root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    rows = []
                    for row in IndexPart(root, name).between(low, high):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

        parts = max(1, self.manifest.count())
        return self.manifest.select("name").repartition(parts, "name").mapInArrow(run, CAPTURES)

    def records(self, low: str | None = None, high: str | None = None, urls: DataFrame | None = None) -> DataFrame:
        """Every record of a key range, or of ``urls``, read back from the archives (RECORDS): captures are dealt by
        stretches of an archive, tasks in proportion to bytes, and neighbouring byte ranges are read together."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, folder = _open(root)
            for batch in batches:
                rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
                for file, low_, spans in _runs(rows):
                    with fs.open_input_file(f"{folder}/{file}") as f:
                        f.seek(low_)
                        data = f.read(spans[-1][0] + spans[-1][1] - low_)
                    out = []
                    for offset, length in spans:
                        r = parse(zlib.decompress(data[offset - low_ : offset - low_ + length], wbits=31))
                        page, refers = r.fields.get("X-Page-ID"), r.fields.get("X-Refers-To-Page-ID")
                        out.append((page and int(page), int(r.http["Content-Length"]), r.fields["WARC-Payload-Digest"].removeprefix("sha1:"), r.fields["WARC-Type"], refers and int(refers)))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        found = self.all_captures(low, high) if urls is None else self.lookup(urls)
        total = self.manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        stretch = max(_READ, -(-total // _READERS))
        dealt = found.select("file", "offset", "length").repartition(max(1, -(-total // stretch)), "file", F.floor(F.col("offset") / stretch))
        return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def _runs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Group sorted (file, offset, length) into reads of at most _GAP bytes, or one longer record."""
    file, start, spans = None, 0, []
    for f, offset, length in rows:
        if spans and (f != file or offset + length - start > _GAP):
            yield file, start, spans
            spans = []
        if not spans:
            file, start = f, offset
        spans.append((offset, length))
    if spans:
        yield file, start, spans


def archive(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Write ``pages`` (page_id, url, html) and their index to the shared folder."""
    spark = pages.sparkSession
    root, index_root = fresh_path(spark, "warc"), fresh_path(spark, "cdx")
    captures = write_archives(decide(pages, least_bytes), root)
    return Archive(root, index_root, write_index(captures, index_root))


#: DuckDB: the rows of the op2 query.
SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p
), m AS (
  SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS holder FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM m
"""
