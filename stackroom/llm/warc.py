"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding some WARC records, and
ends with a seek table in a skippable frame (magic 0x184D2A5E; per frame its compressed and
decompressed size; a footer with the number of frames, a descriptor byte and the magic
0x8F92EAB1), as the public seekable format lays out. Any Zstandard tool can read a bundle;
a reader with the seek table decompresses only the frames it needs. An index maps record
identifiers to (bundle, frame, the frame's bytes within the bundle, offset within the frame).

Bundles are rows of a Parquet table in the shared folder, so Spark's committer makes task
retries safe and any file system Spark writes to will do; :func:`export` turns them into
``.warc.zst`` files of a folder that pyarrow can reach, and :func:`fetch_files` reads single
frames of those by their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.session import cut

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC 1.1 record. A revisit has no block; its headers keep the full payload's digest and length."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    # Header values are single lines: a URL is percent-encoded where it would break one.
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {target}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("truncated record")
    return head, block, end + 8 + size


class BundleWriter:
    """Frames of about ``frame_bytes``; :meth:`close` appends the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self._flush()
        where = len(self.sizes), self.held
        self.pending.append(data)
        self.held += len(data)
        self.total += len(data)
        return where

    def _flush(self):
        if self.held:
            frame = self.codec.compress(b"".join(self.pending))
            self.parts.append(frame)
            self.sizes.append((len(frame), self.held))
            self.pending, self.held = [], 0

    def close(self) -> bytes:
        self._flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at = len(bundle) - 9 - width * count
    if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE_MAGIC, width * count + 9):
        raise ValueError("damaged seek table")
    out, start = [], 0
    for k in range(count):
        small, full = struct.unpack("<II", bundle[at + width * k : at + width * k + 8])
        out.append((start, small, full))
        start += small
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    start, small, full = entry
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + small], max_output_size=full)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: decompresses a single frame."""
    head, block, _ = parse(read_frame(bundle, seek_table(bundle)[frame]), offset)
    return head, block


_BUNDLES = pa.schema([("bundle", pa.string()), ("archive", pa.large_binary()), ("ids", pa.list_(pa.int64())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("refers", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_BUNDLE_COLUMNS = "bundle string, archive binary, ids array<long>, frames array<int>, offsets array<long>, refers array<long>, starts array<long>, sizes array<long>"


def _write(frame_bytes, bundle_bytes):
    def run(batches):
        writer, index, first = None, [], None

        def done():
            name = f"bundle-{hashlib.sha1(repr((first, len(index), index[-1][0])).encode()).hexdigest()[:16]}.warc.zst"
            archive = writer.close()
            table = seek_table(archive)
            rows = [(page, frame, offset, refers, *table[frame][:2]) for page, frame, offset, refers in index]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive], pa.large_binary()), *(pa.array([list(c)], f.type) for c, f in zip(zip(*rows), list(_BUNDLES)[2:]))], schema=_BUNDLES)

        for batch in batches:
            for page, url, html, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), K.raw(batch.column(2)), batch.column(3).to_pylist()):
                if writer is None:
                    writer, index, first = BundleWriter(frame_bytes), [], page
                index.append((page, *writer.add(record(page, url, html or b"", refers)), refers))
                if writer.total >= bundle_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, *, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of a table ``(page_id, url, html)``: name, archive and, in lists, the place of each record.

    Of records with equal payloads of at least ``min_bytes`` bytes, that of the smallest id is
    a response and the others revisit it. Repeated rows with that id are responses too, and so
    are all records of a null id. A null html is an empty payload, a null url no header.
    Payloads are kept whole, however long: one longer than a frame or a bundle has its own.
    Ids are whole numbers or null. Other columns are ignored, whatever their names. No pages,
    no bundles.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = base.withColumn("key", F.when(F.octet_length(payload) >= min_bytes, F.unhex(F.sha2(payload, 256))))
    first = cut(keyed.where("key is not null and page_id is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("key", "first"), "payloads")
    ready = keyed.join(first, "key", "left").select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))
    return cut(ready.mapInArrow(_write(frame_bytes, bundle_bytes), _BUNDLE_COLUMNS), "warc")


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.large_binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())])


def _number(urn: str | None):
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


def _read(payloads):
    schema = _RECORDS if payloads else pa.schema([f for f in _RECORDS if f.name != "payload"])

    def run(batches):
        for batch in batches:
            for name, bundle, ids, frames, offsets in zip(batch.column(0).to_pylist(), K.raw(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4))):
                table = seek_table(bundle)
                if sorted(set(frames)) != list(range(len(table))):
                    raise ValueError(f"the index of {name} does not name every frame")
                at = 0
                for frame, entry in enumerate(table):
                    data, rows, end = read_frame(bundle, entry), [], 0
                    while at < len(ids) and frames[at] == frame:
                        start = offsets[at]
                        head, block, past = parse(data, start)
                        number = _number(head["WARC-Record-ID"])
                        if start != end or number != ids[at]:
                            raise ValueError(f"the index of {name} has another record at frame {frame}, {start}")
                        end, at = past, at + 1
                        declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and digest(block) != declared:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                        refers = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                        row = (number, int(head["X-Payload-Length"]), declared, head["WARC-Type"], refers, head.get("WARC-Target-URI"), block, name, frame, start)
                        rows.append(row if payloads else row[:6] + row[7:])
                    if end != len(data):
                        raise ValueError(f"the index of {name} misses records of frame {frame}")
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(bundles: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Every record of the bundles, read where the index says: id, full payload's length and digest, type, what it refers to, its place.

    Fails if index, seek table and records disagree, or if a payload does not match its digest.
    """
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, " + ("payload binary, " if payloads else "") + "bundle string, frame int, frame_offset long"
    return bundles.select("bundle", "archive", "ids", "frames", "offsets").mapInArrow(_read(payloads), kinds)


_PLACE = ["bundle", "frame", "frame_start", "frame_bytes", "frame_offset"]


def index_of(bundles: DataFrame) -> DataFrame:
    """``(page_id, refers_to, bundle, frame, frame_start, frame_bytes, frame_offset)`` for every record; bytes are those of the bundle."""
    rows = bundles.select("bundle", F.explode(F.arrays_zip("ids", "refers", "frames", "starts", "sizes", "offsets")).alias("e"))
    return rows.select(F.col("e.ids").alias("page_id"), F.col("e.refers").alias("refers_to"), "bundle", F.col("e.frames").alias("frame"), F.col("e.starts").alias("frame_start"), F.col("e.sizes").alias("frame_bytes"), F.col("e.offsets").alias("frame_offset"))


def _places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(page_id, bundle, frame, ...)`` of the payloads of wanted ids: that of a revisit is where it refers to."""
    own = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    sources = index.where("refers_to is null").groupBy("page_id").agg(F.min(F.struct(*_PLACE)).alias("at"))
    direct = own.where("refers_to is null").select("page_id", F.struct(*_PLACE).alias("at"))
    through = own.where("refers_to is not null").select("page_id", "refers_to").join(sources.withColumnRenamed("page_id", "refers_to"), "refers_to").select("page_id", "at")
    return direct.unionByName(through).select("page_id", "at.*")


_PAYLOADS = "bundle string, frame_start long, frame_offset long, payload binary"
_PAYLOAD_SCHEMA = pa.schema([("bundle", pa.string()), ("frame_start", pa.int64()), ("frame_offset", pa.int64()), ("payload", pa.large_binary())])


def _payloads(name: str, start: int, frame: bytes, offsets: list) -> pa.RecordBatch:
    """The payloads of one compressed frame."""
    data = zstandard.ZstdDecompressor().decompress(frame)
    blocks = [parse(data, o)[1] for o in offsets]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array([start] * len(blocks), pa.int64()), pa.array(offsets, pa.int64()), pa.array(blocks, pa.large_binary())], schema=_PAYLOAD_SCHEMA)


def _with_payloads(places: DataFrame, found: DataFrame) -> DataFrame:
    return places.join(found, ["bundle", "frame_start", "frame_offset"]).select("page_id", "payload")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(page_id, payload)`` for each record of some ids, by random access: a frame is decompressed once, whatever is wanted of it.

    Revisits give the payload they refer to. Ids that no record has give no row, a null id neither.
    """
    places = cut(_places(index_of(bundles), wanted), "places")
    frames = places.groupBy("bundle", "frame_start", "frame_bytes").agg(F.collect_set("frame_offset").alias("offsets"))
    asked = frames.groupBy("bundle").agg(F.collect_list(F.struct("frame_start", "frame_bytes", "offsets")).alias("asked"))

    def run(batches):
        for batch in batches:
            for name, archive, own in zip(batch.column(0).to_pylist(), K.raw(batch.column(1)), batch.column(2).to_pylist()):
                for f in own:
                    yield _payloads(name, f["frame_start"], archive[f["frame_start"] : f["frame_start"] + f["frame_bytes"]], f["offsets"])

    found = bundles.select("bundle", "archive").join(asked, "bundle").mapInArrow(run, _PAYLOADS)
    return _with_payloads(places, found)


def fetch_files(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """As :func:`fetch`, from the files of :func:`export`: only the bytes of wanted frames are read."""
    places = cut(_places(index, wanted), "places")
    frames = places.groupBy("bundle", "frame_start", "frame_bytes").agg(F.collect_set("frame_offset").alias("offsets"))

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for name, start, size, offsets in zip(*(batch.column(k).to_pylist() for k in range(4))):
                with store.open_input_file(f"{root}/{name}") as f:
                    yield _payloads(name, start, f.read_at(size, start), offsets)

    return _with_payloads(places, frames.mapInArrow(run, _PAYLOADS))


def _store(folder: str):
    """The file system of a URI (``file``, ``hdfs``, ``s3``, ``gs``) or plain path, and the path within it."""
    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), folder.rstrip("/")
    store, root = fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file of a shared folder (a URI or a mounted path); returns ``(bundle, path, bytes)``.

    Retries are safe: a file is written under a name of its own and then moved, and any try
    gives the same bytes.
    """

    def run(batches):
        import uuid

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, archive in zip(batch.column(0).to_pylist(), K.raw(batch.column(1))):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(archive)
                store.move(part, f"{root}/{name}")
                out.append((name, f"{root}/{name}", len(archive)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.int64())], names=["bundle", "path", "bytes"])

    return bundles.select("bundle", "archive").mapInArrow(run, "bundle string, path string, bytes long")
