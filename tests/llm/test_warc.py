import hashlib
import struct
from collections import Counter

import pytest
import zstandard
from helpers import LONG, prose
from pyspark.sql import functions as F

from claimspark.llm import warc
from claimspark.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def pages():
    page = "<html><body>" + prose(3, 300) + "é😀</body></html>"
    out = [(1, "http://a/1", page), (5, "http://a/5", page), (3, None, page), (5, "http://a/5", page), (7, "http://x/\r\nWARC-Type: x%0D", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (None, "u", prose(4, 200)), (11, "u", LONG)]
    return out + [(20 + i, f"http://b/{i}", "<html><head><title>t</title></head><body>" + prose(60 + i, 100) + "</body></html>") for i in range(60)]


def test_round_trip(spark):
    path = scratch_path(spark, "test-warc")
    df = spark.createDataFrame(pages(), PAGES).repartition(2).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1)).withColumn("revisit", F.lit(1))
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    top = {}
    for i, _, h in pages():
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, u, h in pages():
        b = (h or "").encode()
        again = len(b) >= 1000 and top[h or ""] not in (-1, i)
        want[i, u, "revisit" if again else "response", top[h or ""] if again else None, len(b), hashlib.sha1(b).hexdigest(), None if again else b] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert all(r.error is None for r in got)
    archive = bytes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).orderBy(F.col("length").desc()).first().content)
    assert struct.unpack_from("<I", archive)[0] == warc.DICT_MAGIC
    # Any Zstandard reader with the dictionary takes the archive as one stream.
    size = struct.unpack_from("<I", archive, 4)[0]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    assert reader.stream_reader(archive, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")


def test_archives_are_of_bounded_size(spark):
    path = scratch_path(spark, "test-warc-small")
    df = spark.createDataFrame([(i, "u", prose(i, 400)) for i in range(300)], PAGES).coalesce(1)
    warc.write(df, path, archive_bytes=100_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert len(sizes) > 1 and max(sizes) < 600_000
    assert sorted(r.page_id for r in warc.read(spark, path).collect() if r.error is None) == list(range(300))


def test_unsound_records_are_told():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-5], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    pack = zstandard.ZstdCompressor().compress(good)
    with pytest.raises(ValueError):
        list(warc.unpacked(pack[:-3]))
    with pytest.raises(ValueError):
        list(warc.unpacked(pack + struct.pack("<II", warc.DICT_MAGIC, 0)))


def test_damaged_archives_give_their_sound_records(spark, tmp_path):
    records = [warc.record(i, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False) for i in range(3)]
    frames = [zstandard.ZstdCompressor().compress(r) for r in records]
    for n, damaged in enumerate((b"".join(frames)[:-3], frames[0] + frames[1] + b"\x28\xb5", frames[0] + frames[1] + b"no zstd frame here", frames[0] + frames[1] + frames[2][:6] + b"\xff" * 40)):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.warc.zst").write_bytes(damaged)
        got = warc.read(spark, str(folder)).collect()
        assert [r.page_id for r in got] == [0, 1, None] and got[2].error


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
