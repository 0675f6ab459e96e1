"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. Spark's text writer puts the members one behind the other: its line separator
is a single zero byte, and that byte is the last byte of every member (the top byte of the length field; a member whose
top byte isn't zero is closed by an empty member). So the files are plain record-wise gzip, written and committed by Spark
on whatever store the path names.

The reader is splittable. Spark's text source cuts each byte range at the gzip magic (the line separator when reading), and
a range owns the pieces that start in it. From its first piece whose gzip header and WARC header decode, a range takes member
after member; a piece that comes before a member is whole is data that happens to look like the magic. What stands before
that first piece (the rest of a record, or a record cut in its head) is joined to the ranges before it.
Archives named .gz are read as they lie too, but Hadoop splits no file of that name: each is one range, in pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: Fixed values of RFC 1952: magic with method deflate; an empty member.
MAGIC = b"\x1f\x8b\x08"
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x02\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Payloads below this size are always stored.
LEAST_BYTES = 100
#: Digests of repeated payloads that may be broadcast (about 150 bytes each); they are counted first.
BROADCAST_DIGESTS = 200_000
#: Has Hadoop hand out the bytes of files named .gz unchanged; its shaded client knows the second setting under a longer name.
AS_IS = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
}

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member (or two) without its last byte, which is zero."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    whole = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return whole[:-1] if whole[-1] == 0 else whole + EMPTY[:-1]


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record_name(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 response or revisit record; the HTTP header tells the size of the full payload in either."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id, url, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_name(refers_to, refers_url, digest)}", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To-Target-URI: {_line(refers_url)}"] if refers_url is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple | None:
    """The fields of a response or revisit record; None for other record types and an empty member. Raises ValueError where checks fail."""
    if not record:
        return None
    if not record.startswith(b"WARC/"):
        raise ValueError("a gzip member holds no WARC record")
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("warc-type", "")
    block = rest[: int(fields.get("content-length", "0"))]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)
    size = int(told[1]) if told else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and digest and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record of {fields.get('warc-target-uri')}: the payload does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("page-id"), fields.get("warc-target-uri"), kind, number("refers-to-page-id"), size, digest, payload if kind == "response" else None


def starts_record(piece: bytes) -> bool:
    """Whether bytes behind a magic surely begin a gzip member with a WARC record. A cut in the member's head leaves it open."""
    if len(piece) < 7 or piece[0] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(MAGIC + piece[:4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


class Members:
    """The gzip members of bytes that come in pieces, in file order from a member's first byte. Zeros between members are padding.

    Each byte is decoded once, wherever the pieces are cut: a member ends where its trailer does, and the next begins there.
    """

    def __init__(self, file: str) -> None:
        self.file, self.rest = file, []  # rest: the bytes of the member that is not whole yet
        self._opened, self._out = None, []

    def feed(self, data: bytes) -> list[bytes]:
        """The contents of the members that these bytes make whole."""
        found = []
        while data:
            self._opened = self._opened or zlib.decompressobj(31)
            self.rest.append(data)
            try:
                self._out.append(self._opened.decompress(data))
            except zlib.error as e:
                raise ValueError(f"a record in {self.file} is damaged: {e}") from e
            if not self._opened.eof:
                break
            data = self._opened.unused_data.lstrip(b"\0")
            found.append(b"".join(self._out))
            self.rest, self._opened, self._out = [], None, []
        return found


def with_duplicates(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload (binary), digest, and first_id, first_url: the smallest page_id of equal payloads of at least `least_bytes`.

    Only digests that occur more than once go into the join, one row each: broadcast when counted small, so that no payload
    is shuffled; else a shuffle join, whose skewed side AQE splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.length("payload") >= least_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    again = large.groupBy(F.col("digest").alias("of")).agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(again.select("of", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    return rows.join(broadcast_if_small(again, BROADCAST_DIGESTS), F.col("digest") == F.col("of"), "left").drop("of")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page_id, url, payload, digest, first, first_url in zip(*(b.column(i) for i in range(6)), strict=True):
            page_id, first, payload = page_id.as_py(), first.as_py(), payload.as_py()
            kind = "response" if first is None or first == page_id else "revisit"
            out.append(member(encode_record(page_id, url.as_py(), kind, first if kind == "revisit" else None, digest.as_py(), len(payload), payload, first_url.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """One record per row of pages(page_id, url, html) below `path`; a null html is an empty payload.

    Null ids and urls are left out of the record. If rows repeat with the smallest page_id of a payload, each is a response.
    Payloads of any length are stored whole. An empty table writes no record; other columns are not read.
    """
    rows = with_duplicates(pages, least_bytes).select("page_id", "url", "payload", "digest", "first_id", "first_url")
    members = rows.mapInArrow(_encode, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in file order to records; what may belong to another range goes out as (part, place, bytes)."""
    made: list[tuple] = []
    held = {"range": None, "members": None, "lead": []}

    def leave() -> None:
        """At a range's end: what stood before its first sure start, and the record that is not whole."""
        if held["lead"]:
            made.append((*[None] * 7, *held["range"], b"H" + b"".join(held["lead"])))
        if held["members"] is not None and held["members"].rest:
            made.append((*[None] * 7, *held["range"], b"T" + b"".join(held["members"].rest)))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")] + ["file", "start", "piece"]
        columns = list(zip(*made, strict=True)) or [[]] * 10
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for b in batches:
        for piece, file, start in zip(b.column(0), b.column(1), b.column(2), strict=True):
            at, piece = (file.as_py(), start.as_py()), piece.as_py()
            if at != held["range"]:
                leave()
                held.update(range=at, members=None if at[1] else Members(at[0]), lead=[])
                if at[1] == 0:  # what stands before a file's first magic
                    continue
            if held["members"] is None and starts_record(piece):
                held["members"] = Members(at[0])
            if held["members"] is None:
                held["lead"].append(MAGIC + piece)
            else:
                made += [(*fields, None, None, None) for record in held["members"].feed(MAGIC + piece) if (fields := decode_record(record))]
            if len(made) >= 500:
                yield flush()
    leave()
    yield flush()


def _join_pieces(key: tuple, pieces: pa.Table) -> pa.Table:
    """The few records of one file that no range could tell alone: a tail, then the heads of the ranges behind it.

    A head without a tail before it follows a whole record, so it begins with a member; bytes that make no record are an error.
    """
    rows = sorted(zip(pieces.column("start").to_pylist(), pieces.column("piece").to_pylist(), strict=True), key=lambda r: (r[0], r[1][:1] == b"T"))
    out, members = [], Members(key[0].as_py())
    for _, piece in [*rows, (None, b"T")]:
        if piece[:1] == b"T" and members.rest:
            raise ValueError(f"a record in {members.file} is cut off")
        out += [fields for record in members.feed(piece[1:]) if (fields := decode_record(record))]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives at `path`: the columns of RECORD (payload null for revisits).

    Digests of responses are checked; a damaged record is an error. Without `payloads` they are dropped in the tasks. The
    rare records cut by a false magic at the end of a range or in their own head are joined by a small shuffle by file.
    """
    pieces = spark.read.options(lineSep=MAGIC.decode("latin-1"), encoding="ISO-8859-1", **AS_IS).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    found = pieces.mapInArrow(_decode, f"{RECORD}, file string, start long, piece binary")
    if not payloads:  # small rows: written once, so that the archives are decoded once
        found = written(found.withColumn("payload", F.lit(None).cast("binary")))
    whole = found.filter("piece IS NULL").select(*names)
    cut = found.filter("piece IS NOT NULL").select("file", "start", "piece").groupBy("file").applyInArrow(_join_pieces, RECORD)
    return whole.unionByName(cut if payloads else cut.withColumn("payload", F.lit(None).cast("binary")))
