import hashlib
import random

import zstandard
from helpers import words
from pyspark.sql import functions as F

from reelforge.llm import warc
from reelforge.llm.common import shared_folder

PAGES = "page_id long, url string, html string, record_id string, type string, bundle string"


def pages(spark, rows):
    return spark.createDataFrame([(a, b, c, "r", "t", "b") for a, b, c in rows], PAGES)


def sample():
    shared = words(80, 1)
    rows = [(i, f"http://h{i % 3}/p\r\n{i}é", shared if i % 3 == 0 else words(20 + i, i)) for i in range(90)]
    rows += [(100 + i, None, t) for i, t in enumerate([None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50,
                                                       "é" * 50, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9,
                                                       words(200_000, 5)])]
    random.Random(0).shuffle(rows)
    return rows


def want(rows):
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        f = first.get(t)
        revisit = f is not None and f != i
        out.append((None if i is None else str(i), len(p), hashlib.sha256(p).hexdigest(),
                    "revisit" if revisit else "response", str(f) if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.record_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_and_revisits(spark):
    rows = sample()
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages(spark, rows).repartition(3), folder)
    assert index.count() == len(rows)
    back = warc.read_bundles(spark, folder)
    assert got(back) == want(rows)
    text = {str(i): (t or "").encode() for i, _, t in rows}
    assert all(r.payload == (text[r.record_id] if r.type == "response" else None) for r in back.collect())


def test_fetch_reads_single_records(spark):
    rows = sample()
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages(spark, rows).coalesce(2), folder, frame_bytes=2000)
    ids = spark.createDataFrame([(i,) for i in (0, 3, 50, 109, 105, 3, 12345)], "page_id long")
    found = {r.record_id: r for r in warc.fetch(ids, folder).collect()}
    assert set(found) == {"0", "3", "50", "109", "105"}
    assert found["50"].payload == dict((i, t) for i, _, t in rows)[50].encode() and found["3"].refers_to == "0"
    assert index.select("frame").distinct().count() > 1


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages(spark, [(i, "u", words(3000, i)) for i in range(200)]).coalesce(1), folder)
    name = index.first().bundle
    fs, path = warc.file_system(folder)
    raw = fs.open_input_file(f"{path}/bundles/{name}").readall()
    reader = warc.BundleReader(f"{folder}/bundles", name)
    assert len(reader) > 1
    plain = b"".join(reader.frame(i) for i in range(len(reader)))
    out = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert out == plain and len(list(warc.records(plain))) == 200
    for r in index.limit(20).collect():
        one = reader.frame(r.frame)[r.offset:r.offset + r.length]
        assert [f["WARC-Record-ID"] for f, _ in warc.records(one)] == [f"<urn:page:{r.page_id}>"]


def test_null_and_repeated_ids_and_empty_table(spark):
    t, u = words(60, 1), words(60, 2)
    rows = [(None, "a", t), (5, "b", t), (5, "c", t), (7, "d", t), (None, "e", u), (None, "f", u), (1, None, None)]
    folder = shared_folder(spark, "warc")
    warc.write_bundles(pages(spark, rows), folder)
    assert got(warc.read_bundles(spark, folder)) == want(rows)
    folder = shared_folder(spark, "warc")
    assert warc.write_bundles(pages(spark, rows).limit(0), folder).collect() == []
    assert warc.read_bundles(spark, folder).collect() == []
    assert warc.fetch(spark.createDataFrame([(1,)], "page_id long"), folder).collect() == []


def test_frames_of_one_bundle_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000, raising=False)
    rows = [(i, "u", words(300, i)) for i in range(200)]
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages(spark, rows).coalesce(1), folder, frame_bytes=4000)
    assert index.select("bundle").distinct().count() == 1
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "page_id long")
    for found, n in ((warc.read_bundles(spark, folder), 200), (warc.fetch(ids, folder), 100)):
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == n and len(tasks) > 8 and max(tasks) < n / 3
    assert got(warc.read_bundles(spark, folder)) == want(rows)
