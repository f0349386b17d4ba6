"""Dictionary-compressed WARC archives: records compressed one by one with a Zstandard dictionary that leads the file.

Each archive is made in one task from a bounded run of records. A dictionary is trained on records of that run, put in a leading skippable
frame (magic 0x184D2A5D), and each record becomes a frame of its own, so that any record can be read alone. Of records with equal payloads of at least
REVISIT_BYTES, the one with the largest page_id is a response and the others are revisits that hold no payload; this is settled by digest
before anything is written, with one row per digest, and brought to the pages by their id, so that a frequent payload is not gathered anywhere.

Archives go to a folder through pyarrow's file systems (local or mounted folders, hdfs, s3, gs), each attempt of a task under names of its own. Which of them count is
told by a manifest, a Parquet table that Spark commits with the rows of successful attempts only; what a lost attempt left is never read. Tasks open the manifest's
archives one by one when reading.

Defined cases: a null html is an empty payload; a null url or page_id leaves its header out. Repeated rows with the largest id
are all responses. Empty tables give no archives and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES = 1000, 24 << 20, 32 << 10, 2 << 20
SKIPPABLE, DICTIONARY_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
MOST_READERS = 20_000
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = long.join(first, "digest").filter(F.col("page_id") < F.col("first")).select("digest", "page_id", F.col("first").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record. The block is the payload itself; a revisit has none. Ids come from the content, so that a repeated task writes the same bytes."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", f"X-Refers-To-Page: {refers_to}"]
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary in a skippable frame, then a frame for each record. Too few records for a dictionary give an empty leading frame."""
    import zstandard as zstd

    total = sum(map(len, records))
    step = max(1, total // TRAIN_BYTES)
    samples = records[::step]
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstd.ZstdError:
        trained = None
    raw = trained.as_bytes() if trained else b""
    packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True) if trained else zstd.ZstdCompressor(level=3)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(packer.compress, records))


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    import zstandard as zstd

    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    raw, rest = content[8 : 8 + n], memoryview(content)[8 + n :]
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw) if n else None)
    while len(rest):
        frame = unpack.decompressobj()
        data = frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]
        head, _, body = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages and the manifest, a row per archive: path, records, bytes. Returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt, number, waiting, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, size
            content = archive(waiting)
            path = f"{root}/{attempt}-{number:05d}.warc.zst"
            with files.open_output_stream(path, compression=None) as f:
                f.write(content)
            made = pa.RecordBatch.from_pydict({"path": [path], "records": [len(waiting)], "bytes": [len(content)]})
            number, size = number + 1, 0
            waiting.clear()
            return made

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    waiting.append(record(*row))
                    size += len(waiting[-1])
                    if size >= archive_bytes:
                        yield out()
        if waiting:
            yield out()

    made = planned(pages).mapInArrow(run, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return _manifest(pages.sparkSession, folder)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, checked against its digest; a revisit's payload is null and stands in the record it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with files.open_input_stream(path, compression=None) as f:
                content = f.read()
            rows = []
            for h, block in read_archive(content):
                digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                number = lambda k, h=h: int(h[k]) if k in h else None
                rows.append((number("X-Page-Id"), h.get("WARC-Target-URI"), kind, number("X-Refers-To-Page"), digest, number("X-Payload-Length"), block if kind == "response" else None))
                if len(rows) == 500:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    archives = _manifest(spark, folder).select("path")
    return archives.repartition(max(1, min(archives.count(), MOST_READERS))).mapInArrow(run, RECORDS)
