"""WARC records in seekable Zstandard bundles.

Writing: every task writes its records to bundle files.  Records are grouped
into independent Zstandard frames of about ``FRAME_BYTES``; a footer holds
the seek table of the public seekable format (a skippable frame with the
compressed and plain size of every frame).  The index maps a record id to its
bundle, frame and the offset inside the plain frame.  Reading one record
opens the bundle, reads the footer, then decompresses one frame.  Readers get
frames, not bundles: the frames are dealt over as many tasks as their plain
sizes in the index ask for (an explicit number, which AQE does not coalesce).

Repeated payloads: of the records with equal payloads of at least
``MIN_SHARED`` bytes the one with the smallest id is a response, the others
are revisit records that name it; smaller payloads are always responses.
Only (digest, id) pairs are grouped; a payload that very many records share
is dealt over ``SALTS`` cells when the rows meet their group.

Bundles are written under a name of their own per attempt and published by a
rename, so a repeated or speculative attempt never touches a finished file;
the index lists the files of the attempts that counted.  Files go through
``pyarrow.fs`` to the shared folder, whatever store that is.

Defined results: a null payload is empty; a null url is written as empty; a
null id cannot be the smallest: such a record is a response only if its group
has no id at all (``refers_to`` is null then); rows that repeat the smallest
id of a group are all responses; an empty table gives no bundles and an empty
index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SHARED, SALTS = 100, 64
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Plain bytes of frames that a reading task gets.
TASK_BYTES = 32 << 20
#: Magic numbers of the public Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LENGTH_FIELD = "X-Payload-Length"


# --- bundles --------------------------------------------------------------

def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if ":/" not in uri
                                    else uri.replace(":/", ":///", 1))


class BundleWriter:
    """Frames of whole records and a footer with their seek table."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        self.sink = self.fs.open_output_stream(f"{self.folder}/.{self.name}", compression=None)
        self.zip = zstandard.ZstdCompressor(level=6)
        self.frames: list[tuple[int, int]] = []
        self.plain, self.size = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the plain frame, length) of the record."""
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self._frame()
        at = len(self.frames), len(self.plain), len(record)
        self.plain += record
        return at

    def _frame(self) -> None:
        packed = self.zip.compress(bytes(self.plain))
        self.sink.write(packed)
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain = bytearray()

    def close(self) -> str:
        if self.plain:
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()
        self.fs.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        return self.name


class BundleReader:
    def __init__(self, folder: str, name: str):
        fs, path = file_system(folder)
        self.source = fs.open_input_file(f"{path}/{name}")
        size = self.source.size()
        self.source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.source.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        self.source.seek(size - 9 - 8 * n)
        table = np.frombuffer(self.source.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = table[:, 1]

    def __len__(self) -> int:
        return len(self.plain)

    def frame(self, i: int) -> bytes:
        self.source.seek(int(self.begin[i]))
        packed = self.source.read(int(self.begin[i + 1] - self.begin[i]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.plain[i])))

    def close(self) -> None:
        self.source.close()


# --- records ----------------------------------------------------------------

def _header_text(value: object) -> str:
    return "".join(c if c.isprintable() else " " for c in str(value))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the payload's length."""
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", _header_text(url or "")),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              (LENGTH_FIELD, len(payload))]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = b"" if revisit else payload
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a plain frame: (fields, block)."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, plain[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def urn_id(value: str | None) -> str | None:
    return (value or "")[len("<urn:page:"):-1] or None


# --- operators ----------------------------------------------------------------

def first_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """The rows with ``_wc_digest`` and ``_wc_first``, the smallest id that
    has the same payload (null if nothing else has it or it is small)."""
    cols = pages.columns
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(*cols, F.sha2(payload, 256).alias("_wc_digest"),
                        F.octet_length(payload).alias("_wc_bytes"),
                        (F.abs(F.xxhash64(id_col) % SALTS)).cast("int").alias("_wc_salt"))
    shared = (rows.where(F.col("_wc_bytes") >= MIN_SHARED)
              .groupBy("_wc_digest").agg(F.min(id_col).alias("_wc_first"), F.count("*").alias("_wc_n"))
              .where("_wc_n > 1").drop("_wc_n")
              .withColumn("_wc_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return rows.join(shared, ["_wc_digest", "_wc_salt"], "left").select(*cols, "_wc_digest", "_wc_first")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write every row as a record; the stored index: id, bundle, frame,
    offset, length."""
    rows = first_records(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(
        F.col(id_col), F.col(url_col).cast("string"), F.col(payload_col).cast("string"), "_wc_digest",
        F.when(F.col(id_col).eqNullSafe(F.col("_wc_first")), None).otherwise(F.col("_wc_first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out = None, []

        def done() -> pa.RecordBatch:
            bundle = writer.close()
            ids, places = [x[0] for x in out], np.array([x[1] for x in out], np.int64)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array([bundle] * len(ids)), *[pa.array(places[:, i]) for i in range(3)]],
                names=[id_col, "bundle", "frame", "offset", "length"])
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                for page_id, url, payload, digest, first in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns]):
                    writer = writer or BundleWriter(f"{folder}/bundles", frame_bytes)
                    place = writer.add(record(page_id, url, (payload or "").encode(), digest, first))
                    out.append((page_id, place))
                    if writer.size >= BUNDLE_BYTES:
                        yield done()
                        writer = None
        if writer:
            yield done()

    kind = pages.schema[id_col].dataType.simpleString()
    index = rows.mapInArrow(run, _index_schema(id_col, kind))
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def _index_schema(id_col: str, kind: str) -> str:
    return f"`{id_col}` {kind}, bundle string, frame long, offset long, length long"


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that the index lists: ``record_id``, ``type``,
    ``url``, ``digest``, ``refers_to`` (ids as text), ``payload_bytes`` and
    ``payload`` (null for a revisit).  A payload that does not have its
    digest or length is an error."""
    index = spark.read.schema("bundle string, frame long, length long").parquet(f"{folder}/index")
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for batch in batches:
            for name, frame in zip(*[c.to_pylist() for c in batch.columns]):
                if held != name:
                    if reader:
                        reader.close()
                    held, reader = name, BundleReader(f"{folder}/bundles", name)
                yield _rows(records(reader.frame(frame)))
        if reader:
            reader.close()

    return _dealt(frames, frames).select("bundle", "frame").mapInArrow(run, _RECORD)


def _dealt(places: DataFrame, frames: DataFrame) -> DataFrame:
    """The places by frame, in tasks of about TASK_BYTES of the frames."""
    total = frames.agg(F.sum("bytes")).first()[0] or 0
    return (places.repartition(max(1, -(-total // TASK_BYTES)), "bundle", "frame")
            .sortWithinPartitions("bundle", "frame"))


def fetch(ids: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """The records of the ids, each by its frame and offset alone."""
    kind = ids.schema[id_col].dataType.simpleString()
    index = ids.sparkSession.read.schema(_index_schema(id_col, kind)).parquet(f"{folder}/index")
    places = index.join(ids.select(id_col).distinct(), id_col).select("bundle", "frame", "offset", "length")
    wanted = (index.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes"))
              .join(places.select("bundle", "frame").distinct(), ["bundle", "frame"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, plain = (None, None), None, b""
        for batch in batches:
            for name, frame, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if held[0] != name:
                    if reader:
                        reader.close()
                    reader = BundleReader(f"{folder}/bundles", name)
                if held != (name, frame):
                    plain, held = reader.frame(frame), (name, frame)
                yield _rows(records(plain[offset:offset + length]))
        if reader:
            reader.close()

    return _dealt(places, wanted).mapInArrow(run, _RECORD)


_RECORD = ("record_id string, type string, url string, digest string, refers_to string, "
           "payload_bytes long, payload binary")


def _rows(found: Iterator[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    rows = []
    for fields, block in found:
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        size = int(fields[LENGTH_FIELD])
        if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        rows.append((urn_id(fields["WARC-Record-ID"]), kind, fields["WARC-Target-URI"], digest,
                     urn_id(fields.get("WARC-Refers-To")), size, block if kind == "response" else None))
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = ["record_id", "type", "url", "digest", "refers_to", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
