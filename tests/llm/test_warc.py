import hashlib

import pyarrow.fs as fs
import zstandard

from marginalia.llm import warc
from marginalia.llm.warc import read_archives, write_archives

PAGES = "page_id bigint, url string, html string, digest string, first string, bundle string"


def rows():
    long = "<p>" + "ü" * 60 + "</p>"
    out = [(i, f"http://h/{i}\r\nX-Evil: 1", f"<html>{i}" + "x" * (i * 37 % 400)) for i in range(60)]
    out += [(200, "u", long), (100, None, long), (150, "u", long), (100, "u", long), (None, "u", long), (201, "u", "short"), (202, "u", "short"), (203, "u", None), (204, "u", ""), (205, "u", "\r\n\r\n" * 40), (206, "u", "y" * 300_000)]
    return [(*r, "clash", "clash", "clash") for r in out]


def test_round_trip(spark):
    data = rows()
    index = write_archives(spark.createDataFrame(data, PAGES))
    got = read_archives(index).collect()
    assert len(got) == len(data)
    first = {}
    for i, _, h, *_ in data:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    expected = []
    for i, _, h, *_ in data:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[h] != i
        expected.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else b))
    mine = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    assert not any("\n" in (r["url"] or "") for r in got)
    named = [r["record_id"] for r in index.collect()]
    assert len(set(named)) == len(data) and "<urn:page:42>" in named and "<urn:page:100>" not in named


def test_reading_follows_the_bytes(spark, monkeypatch):
    """The records of a big bundle are read by several tasks."""
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 12)
    index = write_archives(spark.createDataFrame(rows(), PAGES).coalesce(1))
    assert read_archives(index).rdd.getNumPartitions() > 10 and read_archives(index).count() == len(rows())


def test_one_record_by_one_seek(spark):
    index = write_archives(spark.createDataFrame(rows(), PAGES))
    r = index.filter("page_id = 42").first()
    store, path = fs.FileSystem.from_uri(r["bundle"])
    with store.open_input_file(path) as f:
        table = warc.read_seek_table(f, f.size())
        start, packed, size = table[r["frame"]]
        f.seek(int(start))
        frame = zstandard.ZstdDecompressor().decompress(f.read(int(packed)))
        assert len(frame) == size
        head, payload, _ = warc.parse_record(frame[r["at"] : r["at"] + r["length"]])
        assert head["warc-record-id"] == r["record_id"] and payload.startswith(b"<html>42")
        f.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).readall()
    assert whole.count(b"WARC/1.1\r\n") == index.filter(index.bundle == r["bundle"]).count()


def test_empty_table(spark):
    assert read_archives(write_archives(spark.createDataFrame([], PAGES))).collect() == []
