"""WARC archives as a chunked record table.

Writing: pages become gzip-per-record WARC 1.1 files in the shared folder; a payload that another page of the same
content (at least `least` bytes) already stores becomes a revisit record.  Payloads reach the writer as rows of at most `chunk` bytes.
Each task writes files under names of its own and returns them as rows; only the files of tasks that ended well are in the
manifest, so retried tasks leave nothing twice.

Reading: files are streamed in blocks.  A record becomes rows (record, chunk number) of at most `chunk` bytes, each with the
bytes and the SHA-1 of the payload so far, so no record is ever held whole.  A response's digest and length must be those that
its header tells, and a revisit's those of the response that it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_bytes, new_folder, opened, stage

CHUNK = 256 << 10
_BLOCK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# The profile of revisits, and header fields of our own.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _REFERS, _SIZE = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length"


def with_types(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """pages plus digest, bytes and refers_to: of equal payloads of `least` bytes and more, the largest key stores, others refer to it.

    Only digests and keys are grouped.  Digests that repeat are a table of known size, so payloads move only if it is too large to
    broadcast, and shorter payloads never do.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(body)).withColumn("bytes", F.octet_length(body).cast("long"))
    long = rows.where(F.col("bytes") >= least)
    alike = long.groupBy(F.col("digest").alias("d")).agg(F.max(key).alias("holder"), F.count("*").alias("n")).where("n > 1").select("d", "holder")
    joined = long.join(stage(alike, "alike"), F.col("digest") == F.col("d"), "left")
    own = F.col(f"`{key}`").eqNullSafe(F.col("holder"))
    refers = F.when(~own, F.col("holder"))
    return joined.select(*rows.columns, refers.alias("refers_to")).unionByName(rows.where(F.col("bytes") < least).withColumn("refers_to", F.lit(None).cast(pages.schema[key].dataType)))


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def _head(kind: str, page, url: str | None, digest: str, size: int, refers, length: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"{_SIZE}: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    if url is not None:
        lines.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if page is not None:
        lines.append(f"{_PAGE}: {quote(str(page), safe='')}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"{_REFERS}: {quote(str(refers), safe='')}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """Write a record per row; the manifest (file, records, bytes).

    A null payload is empty, a null key or url leaves its field out, and an empty table gives no files.  Rows of the same
    largest key and payload are all responses; every record has an identifier of its own, also where keys repeat.  Payloads of any length are
    written chunk by chunk.  Keys may be of any ordered type; other columns, whatever their names, are not looked at.
    """
    picked = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{payload}`").alias("payload"))
    rows = with_types(picked, "key", "payload", least)
    body = F.coalesce("payload", F.lit("")).cast("binary")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1)).cast("int") - 1), lambda i: F.substring(body, i * chunk + 1, F.lit(chunk)))
    pieces = F.when(F.col("refers_to").isNotNull(), F.array(F.lit(b""))).when(F.col("bytes") <= chunk, F.array(body)).otherwise(pieces)
    named = rows.select(F.col("key").cast("string").alias("key"), "url", "digest", "bytes", F.col("refers_to").cast("string").alias("refers_to"), F.posexplode(pieces).alias("chunk_no", "data"))
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches):
        out, path, records, size, pack = None, "", 0, 0, None
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(6))
            view = memoryview(data)
            others = [batch.column(i).to_pylist() for i in range(6)]
            for i, (page, at, digest, n, refers, number) in enumerate(zip(*others, strict=True)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = opened(path, "wb")
                parts = []
                if not number:
                    kind = "response" if refers is None else "revisit"
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    length = len(_HTTP) + (n if refers is None else 0)
                    parts = [pack.compress(_head(kind, page, at, digest, n, refers, length)), pack.compress(_HTTP)]
                    records += 1
                parts.append(pack.compress(view[int(offsets[i]) : int(offsets[i + 1])]))
                if refers is not None or (number + 1) * chunk >= n:
                    parts += [pack.compress(b"\r\n\r\n"), pack.flush()]
                size += out.write(b"".join(parts))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return stage(named.mapInArrow(run, "file string, records long, bytes long"), "manifest")


class _Stream:
    """Uncompressed bytes of a multi-member gzip file, a bounded buffer at a time."""

    def __init__(self, source):
        self.source, self.raw, self.unpack, self.held, self.ended = source, b"", zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        while not self.ended:
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(_BLOCK)
                if not self.raw:
                    self.ended = True
                    return False
            got = self.unpack.decompress(self.raw, _BLOCK)
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw = b""
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        at = self.held.find(mark)
        while at < 0:
            before = len(self.held)
            if not self._more():
                return None
            at = self.held.find(mark, max(0, before - len(mark) + 1))
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def some(self, most: int) -> bytes:
        if not self.held:
            self._more()
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            got = self.some(n)
            if not got:
                raise ValueError("the archive ends inside a record")
            parts.append(got)
            n -= len(got)
        return b"".join(parts)


def parsed(source, chunk: int):
    """Rows of the chunk table, record by record; an error where a response is not what its header tells."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").strip().split("\r\n")[1:])
        left = int(fields["Content-Length"])
        http = stream.until(b"\r\n\r\n")
        left -= len(http)
        told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(fields[_SIZE])
        digest, so_far, number = hashlib.sha1(), 0, 0
        page, refers = (None if fields.get(f) is None else unquote(fields[f]) for f in (_PAGE, _REFERS))
        base = {"record_id": fields["WARC-Record-ID"], "page_id": page, "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "refers_to": refers}
        while True:
            data = stream.exactly(min(left, chunk))
            left -= len(data)
            digest.update(data)
            so_far += len(data)
            last = left == 0
            row = base | {"chunk_no": number, "data": data, "bytes_so_far": so_far, "sha1_so_far": digest.hexdigest(), "last": last}
            if last and base["record_type"] == "revisit":
                row |= {"sha1_so_far": told[0], "bytes_so_far": told[1]}
            elif last and (row["sha1_so_far"], so_far) != told:
                raise ValueError(f"the payload of {base['record_id']} is not the one that its header tells")
            yield row
            number += 1
            if last:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")


_CHUNKS = "record_id string, page_id string, record_type string, url string, refers_to string, chunk_no int, data binary, bytes_so_far long, sha1_so_far string, last boolean"


def read(manifest: DataFrame, chunk: int = CHUNK, data: bool = True, key_type: str = "long") -> DataFrame:
    """The chunk table of the manifest's files, a row a record and chunk; without `data` its bytes stay in Python.

    The last chunk of a revisit has the length and digest of the payload that it refers to, as its header tells them; `index` resolves them.
    """
    files = manifest.select("file").repartition(max(1, manifest.count()))
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _CHUNKS.split(", ")])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with opened(path, "rb") as source:
                    for row in parsed(source, chunk):
                        if not data:
                            row["data"] = None
                        rows.append(row)
                        size += 1000 + len(row["data"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    assert names == schema.names
    rows = files.mapInArrow(run, _CHUNKS)
    return rows.withColumn("page_id", F.col("page_id").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def index(chunks: DataFrame) -> DataFrame:
    """A row a record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's length and digest are those of the response that it refers to; one that refers to no such response is an error.
    """
    ends = chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
    ends = stage(ends, "index")
    responses, revisits = ends.where("record_type = 'response'"), ends.where("record_type = 'revisit'")
    # A row for each response that is referred to, however many revisits it has.
    asked = revisits.select(F.col("refers_to").alias("holder"), F.col("payload_digest").alias("told")).distinct()
    held = responses.join(asked, (F.col("page_id") == F.col("holder")) & (F.col("payload_digest") == F.col("told")))
    held = stage(held.select("holder", F.col("payload_digest").alias("found"), F.col("payload_bytes").alias("size")).distinct(), "held")
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    resolved = revisits.join(held, (F.col("refers_to") == F.col("holder")) & (F.col("payload_digest") == F.col("found")), "left")
    resolved = resolved.select("page_id", F.coalesce("size", missing.cast("long")).alias("payload_bytes"), F.coalesce("found", missing.cast("string")).alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(resolved)
