"""WARC archives: records written as whole-file gzip streams, normalised to a gzip member a record, and read by offset.

Writers give one gzip stream for a whole file, which nobody can enter in the middle. The normaliser inflates each such file
once, writes every record again as a member of its own, and an index file beside the archive says where each member lies,
so that a large archive is read by many tasks. Files are named in a manifest when a task ends: what a lost or repeated
task has written is never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, joined_back, map_rows, shared_dir, small_batches, text_of, written

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS
#: Bytes that are inflated or copied at a time, bytes of records after which an archive ends, and records that one task reads.
CHUNK, ARCHIVE, READ = 1 << 18, 64 << 20, 2000
#: Payloads from this size on are deduplicated.
LEAST = 100
DATE = "2000-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to of pages (page_id, url, html): refers_to is null for responses.

    Of equal payloads of `least` bytes or more the rows of the smallest page_id are responses, and the others refer to it;
    null ids count as larger than any, and refer to nothing if all are null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("html").cast("binary").alias("payload")).where(F.octet_length("payload") >= least)
    classes = own.select("page_id", F.sha2("payload", 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
    told = joined_back(rows, written(classes.where("copies > 1"), "classes"), "digest")
    return told.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. The block is a HTTP response; that of a revisit ends with its head, whose Content-Length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    lines.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        lines += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE.decode())]
        payload = b""
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + len(payload)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines), b"", head]) + payload + b"\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's path (file:, hdfs:, s3: ... or a plain local one) and the path there."""
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def write(rows: DataFrame, folder: str, date: str = DATE, size: int = ARCHIVE) -> DataFrame:
    """Write classified rows as archives in `folder`, each one gzip stream; file, records of each (written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        name = out = press = None
        count = length = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, length = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, press = store.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(6, wbits=GZIP)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)
                out.write(press.compress(data))
                count, length = count + 1, length + len(data)
                if length >= size:
                    out.write(press.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})
        if out is not None:
            out.write(press.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})

    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    return written(rows.mapInArrow(run, "file string, records long"), "manifest")


class Inflated:
    """The bytes of a gzip file of one or more members, inflated once, a chunk at a time."""

    def __init__(self, source) -> None:
        self.source, self.unpack, self.held = source, zlib.decompressobj(GZIP), b""

    def more(self) -> bool:
        """Take one more chunk; false at the end of the file."""
        while True:
            data = self.unpack.unconsumed_tail
            if self.unpack.eof:
                data, self.unpack = self.unpack.unused_data, zlib.decompressobj(GZIP)
            data = data or self.source.read(CHUNK)
            if not data:
                return False
            if got := self.unpack.decompress(data, CHUNK):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with `mark`; what is left, if there is none."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                i = len(self.held) - len(mark)
                break
        out, self.held = self.held[: i + len(mark)], self.held[i + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in chunks; an error if the file ends before."""
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends inside a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def members(source, sink) -> Iterator[dict]:
    """Rewrite each record of a gzip file as a member of its own; offset, length (of the member) and header of each.

    A record passes through in chunks, so a task holds one chunk, whatever the sizes of records and files.
    """
    data, offset = Inflated(source), 0
    while True:
        while not data.held.lstrip(b"\r\n"):
            if not data.more():
                return
        data.held = data.held.lstrip(b"\r\n")
        head = data.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/") or not head.endswith(b"\r\n\r\n"):
            raise ValueError(f"no record where one should begin: {head[:40]!r}")
        fields, press, length = fields_of(head), zlib.compressobj(6, wbits=GZIP), 0
        for piece in chain([head], data.exactly(int(fields["content-length"])), [b"\r\n\r\n", None]):
            packed = press.flush() if piece is None else press.compress(piece)
            sink.write(packed)
            length += len(packed)
        yield {"offset": offset, "length": length, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        offset += length


def normalise(manifest: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite the archives of a manifest from `folder` to `target`, a member a record, with an index file beside each; file, records of each (written).

    The index (name of the archive and .idx) has a line of JSON for each record: offset, length, id, type, uri, digest.
    """

    def make() -> Callable[[dict], dict]:
        (store, at), (there, to) = opened(folder), opened(target)

        def each(rows: dict) -> dict:
            names, counts = [], []
            for file in rows["file"]:
                name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                with store.open_input_stream(f"{at}/{file}", compression=None) as source, there.open_output_stream(f"{to}/{name}", compression=None) as sink, there.open_output_stream(f"{to}/{name}.idx", compression=None) as index:
                    for entry in members(source, sink):
                        index.write(json.dumps({"file": name} | entry).encode() + b"\n")
                        count += 1
                names.append(name)
                counts.append(count)
            return {"file": names, "records": counts}

        return each

    store, at = opened(target)
    store.create_dir(at, recursive=True)
    n = max(1, manifest.count())
    dealt = manifest.select("file").repartition(n, "file")
    return written(map_rows(dealt, make, "file string, records long"), "normalised")


def index_of(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """file, offset, length, id, type, uri, digest of the records of a manifest's archives, read from their index files."""
    schema = "file string, offset long, length long, id string, type string, uri string, digest string"
    lines = spark.read.schema(schema).json(f"{folder}/*.idx") if manifest.limit(1).count() else spark.createDataFrame([], schema)
    return lines.join(manifest.select("file"), "file", "left_semi")


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parsed(data: bytes) -> dict:
    """Fields and payload of a member. The digest of a response is computed anew; it has to be the one that the header names."""
    head, _, block = zlib.decompress(data, GZIP).partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that its digest names")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(fields_of(http)["content-length"]) if revisit else len(payload),
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) of the records of an index.

    Records are dealt by ranges of (file, offset), so that a task reads stretches, and a large archive is read by several.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads

    def make() -> Callable[[dict], dict]:
        store, at = opened(folder)
        open_: dict = {}

        def each(rows: dict) -> dict:
            out: dict = {k: [] for k in names}
            for file, offset, length in zip(rows["file"], rows["offset"], rows["length"], strict=True):
                if file not in open_:
                    for old in open_.values():
                        old.close()
                    open_.clear()
                    open_[file] = store.open_input_file(f"{at}/{file}")
                open_[file].seek(offset)
                one = parsed(open_[file].read(length))
                for k in names:
                    out[k].append(one[k])
            return out

        return each

    n = index.count() // READ + 1
    dealt = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return map_rows(dealt, make, RECORDS + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, least: int = LEAST, folder: str | None = None) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of pages (page_id, url, html), as read back from their archives.

    Archives are written as whole-file streams, normalised, and read by their index; those with a member a record stay in
    `folder` (a new one in the shared folder by default), the streams go. A null html is an empty payload, a null url has
    no field, a null page_id comes back as null; repeated rows are records of their own; blanks and control characters
    of a url are escaped. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    streams, target = f"{base}/streams", f"{base}/records"
    manifest = write(classified(pages, least), streams)
    done = normalise(manifest, streams, target)
    store, at = opened(streams)
    store.delete_dir(at)
    discard(manifest)
    return read(index_of(spark, done, target), target)
