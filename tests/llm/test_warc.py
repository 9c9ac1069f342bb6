import io

import pytest
import zstandard
from pyspark.sql import functions as F

from resgov.llm import warc as W

SCHEMA = "page_id long, url string, html string, bundle string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}\r\n\r\né</p>" * (1 + i % 40), "x") for i in range(400)]
    rows += [(1000, None, None, "x"), (1001, "u\r\nX: y", "", "x"), (1002, "u", "WARC/1.1\r\n", "x"), (1002, "u", "WARC/1.1\r\n", "x"), (None, "u", "no id", "x"), (2000, "u", "long " * 200_000, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("least", [0, 200])
def test_round_trip(spark, pages, least, tmp_path_factory, monkeypatch):
    rows = pages.collect()
    largest = {}
    for r in rows:
        if r.page_id is not None:
            largest[r.html or ""] = max(largest.get(r.html or "", -1), r.page_id)
    folder = str(tmp_path_factory.mktemp("warc"))
    index = W.write_archives(pages, folder, least)
    got = W.read_archives(index).collect()
    assert len(got) == len(rows) == index.count()
    by = {r.page_id: r for r in got}
    for r in rows:
        body, x = (r.html or "").encode(), by[r.page_id]
        assert (x.payload_bytes, x.payload_digest) == (len(body), W.digest(body))
        first = r.page_id is None or len(body) < least or largest[r.html or ""] == r.page_id
        assert x.record_type == ("response" if first else "revisit")
        assert x.refers_to == (None if first else largest[r.html or ""]) and x.body == (body if first else None)
    one = W.fetch(index, pages.where("page_id in (17, 2000)")).collect()
    assert {W.parse(bytes(r.record))[0]["X-Page-Id"] for r in one} == {"17", "2000"}


def test_bundle_is_plain_zstandard(tmp_path):
    bundle = W.Bundle(str(tmp_path / "a.warc.zst"))
    records = [W.record(i, "u", "response", b"body %d" % i * 9000, None, "d") for i in range(40)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(records)
    frames = W.read_seek_table(io.BytesIO(raw), len(raw))
    assert len(frames) > 3 and sum(f[2] for f in frames) == len(plain)
    frame, offset = places[33]
    at, packed, _ = frames[frame]
    part = zstandard.ZstdDecompressor().decompressobj().decompress(raw[at:at + packed])
    assert part[offset:offset + len(records[33])] == records[33]


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bundles_are_read_by_a_task_each(spark, pages, tmp_path, monkeypatch):
    """Read tasks grow with the number of bundles; none gathers them all."""
    monkeypatch.setattr(W, "BUNDLE_BYTES", 500)
    monkeypatch.setattr(W, "FRAME_BYTES", 2000)
    index = W.write_archives(pages, str(tmp_path / "w"))
    bundles = index.select("bundle").distinct().count()
    assert bundles > 10
    tasks = W.read_archives(index).withColumn("task", F.spark_partition_id())
    assert tasks.rdd.getNumPartitions() == bundles and tasks.count() == pages.count() and tasks.select("task").distinct().count() > bundles / 2


def test_file_systems_by_scheme(monkeypatch):
    """Hadoop's names for object stores are those of pyarrow's file systems (not resolved here: that needs a network)."""
    assert W.place("/tmp/x")[1] == W.place("file:/tmp/x")[1] == W.place("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="bundles cannot be written"):
        W.place("unheard://host/folder")

    class Recorder:
        from_uri = staticmethod(lambda uri: uri)

    monkeypatch.setattr(W.fs, "FileSystem", Recorder)
    assert W.place("s3a://bucket/shared/folder") == "s3://bucket/shared/folder" and W.place("hdfs://host:1/x") == "hdfs://host:1/x"
    assert W.place("wasbs://c@a.blob/x") == "abfss://c@a.blob/x"


def test_an_unknown_file_system_is_an_error_before_any_work(spark, pages):
    with pytest.raises(ValueError, match="bundles cannot be written"):
        W.write_archives(pages, "unheard://host/folder")
