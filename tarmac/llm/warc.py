"""WARC archives: write captures, read them back as sorted runs, and merge the runs into one ordered index.

Each writing task makes gzip archives of its own in the shared folder; only archives named in the written manifest count, so what a
lost or repeated task leaves behind is never read. Each archive is read back as one locally sorted run of index entries.
The runs are range-partitioned by URL key, time and id, and each range is merged by a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.sources.portions import open_store
from tarmac.sources.scratch import scratch_path, stage

ARCHIVE_BYTES = 1 << 30
RECORD = "<urn:capture:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The host reversed and lower case, then port, path and query; a null or broken URL sorts by its text."""
    try:
        parts = urlsplit((url or "").strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url or ""
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else (url or "")


def record(capture_id: str, url: str | None, when: datetime, payload: bytes | None, size: int, sha1: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the headers of the response but not its payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD.format(capture_id)}",
            f"WARC-Date: {when.strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is None:
        block += payload or b""
    else:
        head += [f"WARC-Refers-To: {RECORD.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = open_store(folder)
    files.create_dir(root, recursive=True)
    done: list[tuple[str, int]] = []
    stream, name, count = None, "", 0

    for batch in batches:
        for key, url, when, html, size, sha1, refers in zip(*(batch.column(i) for i in range(7))):
            if stream is None:
                name, count = f"captures-{uuid.uuid4().hex}.warc.gz", 0
                stream = files.open_output_stream(f"{root}/{name}", compression=None)
            payload = (html.as_py() or "").encode()
            hexed = sha1.as_py()
            stream.write(record(
                key.as_py() if key.is_valid else "", url.as_py(), datetime.fromtimestamp(when.as_py() or 0, UTC), payload, size.as_py(),
                base64.b32encode(bytes.fromhex(hexed)).decode(), refers.as_py()))
            count += 1
            if stream.tell() > ARCHIVE_BYTES:
                stream.close()
                done.append((name, count))
                stream = None
    if stream is not None:
        stream.close()
        done.append((name, count))
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())],
                                     names=["archive", "records"])


def members(source: io.BufferedIOBase | pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, read in pieces."""
    offset, waiting = 0, b""
    while True:
        waiting = waiting or source.read(1 << 20)
        if not waiting:
            return
        unpack, out, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not waiting:
                waiting = source.read(1 << 20)
                if not waiting:
                    raise EOFError("an archive ends inside a record")
            out.append(unpack.decompress(waiting))
            length += len(waiting) - len(unpack.unused_data)
            waiting = unpack.unused_data
        yield offset, length, b"".join(out)
        offset += length


def parse(content: bytes) -> dict[str, Any]:
    """Index facts of a record; the digest of a response is checked against its payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))[16:])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} differ")
    name = lambda text: None if text is None else text.removeprefix("<urn:capture:").removesuffix(">") or None
    return {"id": name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "captured": fields["WARC-Date"],
            "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": name(fields.get("WARC-Refers-To"))}


RUN_FIELDS = ("url_key", "captured", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "position",
              "offset", "length")
RUN_SCHEMA = ("url_key string, captured string, id string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to string, archive string, position bigint, offset bigint, length bigint")
_TYPES = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in RUN_SCHEMA.split(", ")])


def order_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] or "", row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, _TYPES)], schema=_TYPES)


def _runs(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Read whole archives; each gives one run of index entries in order."""
    files, root = open_store(folder)
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            rows = []
            with files.open_input_stream(f"{root}/{archive}", compression=None) as source:
                for offset, length, content in members(source):
                    facts = parse(content)
                    rows.append([url_key(facts["url"]), facts["captured"], facts["id"], facts["payload_bytes"],
                                 facts["payload_digest"], facts["record_type"], facts["refers_to"], archive, 0, offset, length])
            rows.sort(key=lambda row: (row[0], row[1], row[2] or "", row[9]))
            for place, row in enumerate(rows):
                row[8] = place
            for start in range(0, len(rows), 10_000):
                yield _batch([tuple(row) for row in rows[start:start + 10_000]])


class LoserTree:
    """Merges sorted iterators; each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator], key: Callable[[Any], Any]):
        self.runs, self.key, self.size = runs, key, max(1, len(runs))
        self.heads = [next(run, None) for run in runs]
        self.keys = [None if head is None else key(head) for head in self.heads]
        self.losers = [-1] * self.size
        self.winner = self._build(1) if runs else -1

    def _beats(self, one: int, two: int) -> bool:
        first, second = self.keys[one], self.keys[two]
        return second is None or (first is not None and (first, one) < (second, two))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        one, two = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(one, two):
            one, two = two, one
        self.losers[node] = two
        return one

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf]
            head = next(self.runs[leaf], None)
            self.heads[leaf], self.keys[leaf] = head, None if head is None else self.key(head)
            node = (leaf + self.size) // 2
            while node:
                if self._beats(self.losers[node], leaf):
                    self.losers[node], leaf = leaf, self.losers[node]
                node //= 2
            self.winner = leaf


def _rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of one run; only a few of them at a time are Python objects."""
    for part in parts:
        for start in range(0, part.num_rows, 256):
            yield from zip(*(values.to_pylist() for values in part.slice(start, 256).columns))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range's part of every run arrives run by run and in order; it is kept in Arrow columns."""
    runs: list[list[pa.RecordBatch]] = []
    archive = None
    for batch in batches:
        start = 0
        parts = pc.run_end_encode(batch.column(7))
        for name, stop in zip(parts.values.to_pylist(), parts.run_ends.to_pylist()):
            if name != archive or not runs:
                archive = name
                runs.append([])
            runs[-1].append(batch.slice(start, stop - start))
            start = stop
    out: list[tuple] = []
    for row in LoserTree([_rows(run) for run in runs], order_key):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def write(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
          time: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row and return the manifest, archive and records, as a written table.

    Of rows with equal payloads of at least ``least_bytes``, the one with the largest id is the response and the others refer to
    it; rows that repeat that id are responses too. A null payload is empty, a null time is the start of 1970, a null URL
    is left out. A null id is a record without a name; a group of null ids has no response to refer to, so all are responses.
    A folder that tasks cannot write to is refused before any work.
    """
    open_store(folder)
    text = F.coalesce(F.col(column(payload_column)).cast("string"), F.lit(""))
    rows = df.select(
        F.col(column(id_column)).alias("id"), F.col(column(url_column)).cast("string").alias("url"),
        (F.lit(None).cast("bigint") if time is None else time.cast("bigint")).alias("when"), text.alias("html"),
        F.octet_length(text).cast("bigint").alias("size"), F.sha1(text).alias("sha1"))
    shared = stage(rows.where(f"size >= {least_bytes}").groupBy("sha1").agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("members")
    ).where("members > 1 AND keep IS NOT NULL").select(F.col("sha1").alias("_sha1"), "keep"), "payload-groups")
    refers = F.when(F.col("keep").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("keep")), F.col("keep").cast("string"))
    planned = rows.join(shared, F.col("sha1") == F.col("_sha1"), "left").select(
        F.col("id").cast("string").alias("id"), "url", "when", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "sha1",
        refers.alias("refers"))
    return stage(planned.mapInArrow(lambda batches: _write(batches, folder), "archive string, records bigint"), "warc-manifest")


def capture_index(manifest: DataFrame, folder: str) -> DataFrame:
    """All captures of the archives in the manifest, ordered by URL key, time and id over the partitions of the result."""
    tasks = max(1, manifest.count())
    runs = stage(manifest.select("archive").repartition(tasks, "archive").mapInArrow(lambda batches: _runs(batches, folder), RUN_SCHEMA),
                 "capture-runs")
    return runs.repartitionByRange("url_key", "captured", "id", "archive", "position").sortWithinPartitions(
        "archive", "position").mapInArrow(_merge, RUN_SCHEMA)


def round_trip(df: DataFrame, id_column: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Write the rows as archives and return the merged index read back from them, under the type of the id.

    An empty table writes no archive and gives an empty index.
    """
    folder = folder or scratch_path(df.sparkSession, "archives")
    manifest = write(df, folder, id_column, **options)
    kind = df.schema[id_column].dataType
    return capture_index(manifest, folder).select(
        F.col("id").cast(kind).alias(id_column), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "captured", "archive", "offset", "length")
