"""Web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some WARC records, and a seek
table in a skippable frame at its end: the compressed and full size of every frame. The
record index (a table beside the bundles) maps each record to bundle, frame and its offset
within the decompressed frame, so that one record costs one small read.

Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest id is
the response; the others are revisits that name it. Rows that repeat the largest id are
responses too; a null id is smaller than any other. Null payloads and urls count as empty.
Payloads of any length are kept whole: a frame grows with its largest record. An empty table
gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import local_path, ship

#: Fixed values of the public seekable format: skippable frame, and the seek table's end mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
INDEX = "page_id long, bundle string, frame int, offset long, length long"
PARSED = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, url string, payload binary, bundle string, frame int, offset long")


def _files(uri: str):
    """(file system, path) of a folder or file; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(local_path(uri))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", revisit_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only digests that occur twice are joined back, each repeated for every salt, so that
    a digest which many rows share is dealt over ``salts`` tasks."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    shared = (rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("digest").alias("d"), "first",
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s")))
    joined = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _name(page_id) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own but tells its size."""
    from base64 import b32encode

    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}",
             f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_name(refers_to)}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames, then the seek table, into one stream."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.sizes, self.zip = out, [], zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.held, self.bytes = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset within the frame) of the record."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.end_frame()
        at = len(self.sizes), self.held
        self.frame.append(data)
        self.held += len(data)
        return at

    def end_frame(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.bytes += len(packed)
            self.frame, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(place, compressed size, full size) of every frame of an open bundle."""
    end = f.seek(0, 2)
    f.seek(end - 9)
    n, _, mark = struct.unpack("<IBI", f.read(9))
    if mark != SEEKABLE:
        raise ValueError("no seek table at the bundle's end")
    f.seek(end - 9 - 8 * n)
    sizes, at, out = f.read(8 * n), 0, []
    for k in range(n):
        packed, full = struct.unpack_from("<II", sizes, 8 * k)
        out.append((at, packed, full))
        at += packed
    return out


def write_bundles(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z",
                  bundle_bytes: int = BUNDLE_BYTES) -> str:
    """Write the rows of ``with_revisits`` as bundles under ``folder`` and their index as Parquet
    under ``folder``/index, whose path is returned. A bundle's name holds its task attempt:
    what a lost attempt wrote is in no index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        task, number, writer, name = TaskContext.get(), 0, None, ""
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers in zip(*batch.columns):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    writer, number = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None)), number + 1
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), date)
                rows.append((page_id.as_py(), name, *writer.add(data), len(data)))
                if writer.bytes >= bundle_bytes:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    ["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    ship(records.sparkSession)
    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        write, INDEX).write.parquet(f"{folder}/index")
    return f"{folder}/index"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, next place) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    heads = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(heads["Content-Length"])
    return heads, data[start:start + size], start + size + 4


def _row(data: bytes, at: int) -> tuple[tuple, int]:
    """Columns of the record at ``at``; the payload's digest and size are taken anew."""
    from base64 import b32decode

    heads, block, after = parse_record(data, at)
    ident = lambda x: None if x == "<urn:page:null>" else int(x[len("<urn:page:"):-1])
    digest, size = b32decode(heads["WARC-Payload-Digest"][5:]).hex(), int(heads["X-Payload-Length"])
    kind = heads["WARC-Type"]
    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
        raise ValueError(f"damaged record {heads['WARC-Record-ID']}")
    url = heads.get("WARC-Target-URI")
    if url:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    refers = ident(heads["WARC-Refers-To"]) if kind == "revisit" else None
    return (ident(heads["WARC-Record-ID"]), size, digest, kind, refers, url, block), after


def read_bundles(spark: SparkSession, folder: str, task_bytes: int = 32 << 20) -> DataFrame:
    """All records of the indexed bundles. The frames are dealt out to as many tasks as their packed size
    holds ``task_bytes``, and to at least one per core: a number of its own, since the rows that are dealt are
    but addresses, whose size tells nothing of the work."""
    import zstandard

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as f:
                    found = seek_table(f)
                if found:
                    at, packed, full = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()),
                         pa.array(at, pa.int64()), pa.array(packed, pa.int64())], ["bundle", "frame", "at", "packed"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        unzip = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(),
                 pa.string(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            for name, frame, at, packed in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{path}/{name}") as f:
                    f.seek(at)
                    data = unzip.decompress(f.read(packed))
                rows, place = [], 0
                while place < len(data):
                    row, after = _row(data, place)
                    rows.append((*row, name, frame, place))
                    place = after
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    ship(spark)
    bundles = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    listed = bundles.mapInArrow(frames, "bundle string, frame int, at long, packed long")
    packed = listed.agg(F.sum("packed")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-packed // task_bytes))
    return listed.repartition(tasks, "bundle", "frame").mapInArrow(parse, PARSED)


def fetch(folder: str, bundle: str, frame: int, offset: int) -> tuple:
    """One record by its index entry: reads the seek table and one frame."""
    import zstandard

    store, path = _files(folder)
    with store.open_input_file(f"{path}/{bundle}") as f:
        at, packed, _ = seek_table(f)[frame]
        f.seek(at)
        return _row(zstandard.ZstdDecompressor().decompress(f.read(packed)), offset)[0]
