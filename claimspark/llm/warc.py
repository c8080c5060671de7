"""WARC archives compressed with Zstandard: one frame per record, the dictionary in the leading skippable frame.

A task writes archives of about ARCHIVE_BYTES each: a skippable frame (magic 0x184D2A5D) with the dictionary made from the archive's
first records, then a frame for each record. Spark's text writer writes them, so that the archives go to any store
Spark can write and a lost task leaves nothing behind: a record is a line, and the line separator is an empty skippable
frame, which every Zstandard reader passes over. The reader takes whole archives, loads the dictionary, decodes one
frame per record, and checks the version line, the headers and the lengths of each.

Records with equal payloads of at least REVISIT_BYTES: the one with the largest page_id is the response, the others
revisit it and carry no payload. Smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url leaves the header out; pages without an id are responses
unless their payload also belongs to a page with one; rows that repeat page_id and payload have the same type; an empty
table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, scratch_path

REVISIT_BYTES = 1000
#: A new archive begins when one has so many bytes, so that readers can take archives whole.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DICT_BYTES = 16 << 10
#: The dictionary is made from an archive's first records, at most so many and so many bytes of them.
DICT_RECORDS, DICT_SAMPLE = 200, 1 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SEPARATOR = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; digest: SHA-1 of the payload in hex."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small samples: the archive goes without
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, if there is one, then the records'."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= DICT_RECORDS or size >= DICT_SAMPLE:
            break
    if not first:
        return
    made = _dictionary([r[:DICT_SAMPLE // 8] for r in first])
    if made is not None:
        raw = made.as_bytes()
        yield struct.pack("<II", DICT_MAGIC, len(raw)) + raw
        made.precompute_compress(level=LEVEL)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True).compress
    for r in first:
        yield pack(r)
    first.clear()
    for r in records:
        yield pack(r)


def unpacked(archive: bytes) -> Iterator[bytes]:
    """What the frames of an archive hold, one by one. A ValueError tells of damage, behind which nothing is read."""
    try:
        yield from _frames(archive)
    except (struct.error, zstandard.ZstdError) as e:
        raise ValueError(f"damaged archive: {e}") from e


def _frames(archive: bytes) -> Iterator[bytes]:
    at, view, reader = 0, memoryview(archive), zstandard.ZstdDecompressor()
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic in SKIPPABLE:
            (size,) = struct.unpack_from("<I", archive, at + 4)
            if at + 8 + size > len(archive):
                raise ValueError("a skippable frame is cut off")
            if magic == DICT_MAGIC:
                if at:
                    raise ValueError("the dictionary must lead")
                raw = bytes(view[8 : 8 + size])
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26) if raw[:4] == FRAME_MAGIC else raw
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        frame, out, step = reader.decompressobj(), [], 4096
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("a frame is cut off")
            piece = view[at : at + step]
            out.append(frame.decompress(piece))
            at += len(piece)
            step = min(2 * step, 1 << 20)
        at -= len(frame.unused_data)
        yield b"".join(out)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "none" else int(name)


def parse(raw: bytes) -> dict:
    """The fields of a record; raises ValueError for one that isn't sound."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, have = _headers(head)
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no version line")
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if x not in have]:
        raise ValueError(f"lacks {', '.join(missing)}")
    n = int(have["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(_headers(http)[1]["content-length"])
    digest = base64.b32decode(have["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = have["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest is wrong")
    if kind == "revisit" and (payload or "warc-refers-to" not in have):
        raise ValueError("a revisit with a payload or without what it refers to")
    url = have.get("warc-target-uri")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": _page(have["warc-record-id"]), "url": url, "record_type": kind, "refers_to": _page(have["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None, "error": None}


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) of every row. Only digests are grouped; pages meet the
    digests that occur more than once."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= revisit_bytes)
    repeated = cut(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "refers_to"), "warc-repeated")
    joined = rows.join(maybe_broadcast(repeated), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "payload", "digest", "refers_to", revisit.alias("revisit"))


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives, in a folder each: archive=<task>-<number>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield record(*[c[i].as_py() for c in batch.columns])

        task, rows, number = TaskContext.get().partitionId(), records(), 0
        while (first := next(rows, None)) is not None:
            written = [0]

            def own(first: bytes = first, written: list[int] = written) -> Iterator[bytes]:
                yield first
                while written[0] < archive_bytes and (r := next(rows, None)) is not None:
                    yield r

            group, size, at = [], 0, 0
            for frame in frames(own()):
                group.append(frame)
                written[0] += len(frame)
                size += len(frame)
                if size >= 4 << 20:
                    yield of_archive(f"{task}-{number}", at, group)
                    at, group, size = at + len(group), [], 0
            yield of_archive(f"{task}-{number}", at, group)
            number += 1

    def of_archive(name: str, at: int, group: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array([name] * len(group), pa.string()), pa.array(range(at, at + len(group)), pa.int64()), pa.array(group, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "n", "frame"])

    # In order within an archive: Spark's writer takes rows that are sorted by the folder's name as they come.
    lines = planned(pages, revisit_bytes).mapInArrow(work, "archive string, n long, frame binary").sortWithinPartitions("archive", "n")
    lines = lines.select("archive", F.col("frame").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at path. A record that isn't sound has its error and no other field; a damaged archive
    gives its records up to the damage and a row with the error."""

    def sound(archive: bytes) -> Iterator[bytes | str]:
        """The records, and the error that ends them if there is one."""
        try:
            yield from unpacked(archive)
        except ValueError as e:
            yield str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = dict.fromkeys(schema.names)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for raw in sound(batch.column(0)[i].as_py()):
                    try:
                        row = blank | {"error": raw} if isinstance(raw, str) else parse(raw)
                    except (ValueError, KeyError) as e:
                        row = blank | {"error": str(e) or type(e).__name__}
                    size += len(raw)
                    rows.append(row if payloads else row | {"payload": None})
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(work, READ_SCHEMA)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives and gives the records read back, without their payloads."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
