import gzip
import hashlib
import base64
import io
import json
import os
from collections import defaultdict

from tallyfold.llm import warc
from tallyfold.llm.common import fresh_path


def plain(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        best = max(ids, default=None)
        revisit = len(data) >= least and best is not None and i != best
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "<p>one"), (2, "http://b/ x\r\n", "<p>one"), (3, None, "line\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", None), (5, "u", ""),
    (6, "u", "é" * 70000), (7, "u", "é" * 70000), (7, "u", "é" * 70000), (None, "u", "<p>one"), (None, "u", "alone"), (8, "u", "x" * 3_000_000),
]
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string").repartition(2)


def test_round_trip(spark):
    for least in (0, 4):
        back = warc.archive(frame(spark, ROWS), least=least, file_bytes=100_000).collect()
        assert sorted((tuple(r[c] for c in NAMES) for r in back), key=repr) == plain(ROWS, least)
        for r in back:
            if r.record_type == "response":
                assert len(r.payload) == r.payload_bytes


def test_records_are_members_at_their_offsets(spark):
    path = fresh_path(spark, "test-warc")
    warc.archive(frame(spark, ROWS), path).count()
    folder = warc.opened(f"{path}/records")[1]
    files = [f for f in os.listdir(folder) if f.endswith(".warc.gz")]
    total = 0
    for f in files:
        data = open(f"{folder}/{f}", "rb").read()
        index = [json.loads(x) for x in open(f"{folder}/{f}.idx")]
        assert index[0]["offset"] == 0 and index[-1]["offset"] + index[-1]["length"] == len(data)
        for x in index:
            member = gzip.GzipFile(fileobj=io.BytesIO(data[x["offset"] : x["offset"] + x["length"]])).read()
            assert member.startswith(b"WARC/1.1\r\n") and x["id"].encode() in member
        total += len(index)
    assert total == len(ROWS)


def test_several_members_and_broken_archives(tmp_path):
    one = warc.record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    (tmp_path / "a.gz").write_bytes(gzip.compress(one + one[:70]) + gzip.compress(one[70:]))
    index = warc.normalise_file(str(tmp_path / "a.gz"), str(tmp_path / "b.gz"))
    assert len(index) == 2 and gzip.decompress((tmp_path / "b.gz").read_bytes()) == one + one
    (tmp_path / "c.gz").write_bytes(gzip.compress(one[:-20]))
    try:
        warc.normalise_file(str(tmp_path / "c.gz"), str(tmp_path / "d.gz"))
    except ValueError:
        return
    raise AssertionError("a cut archive must be refused")


def test_archives_are_normalised_by_tasks_of_their_own(spark):
    path = fresh_path(spark, "test-warc")
    pages = frame(spark, [(k, "u", "text of a page " * 200 + str(k)) for k in range(60)]).repartition(3)
    manifest = warc.write(warc.revisits(pages, 0), f"{path}/streams", file_bytes=4096)
    archives = manifest.count()
    index = warc.normalise(manifest, f"{path}/streams", f"{path}/records")
    assert archives > 8 and len(index.inputFiles()) == index.select("file").distinct().count() == archives
    assert warc.read(index, f"{path}/records").count() == 60


def test_no_pages(spark):
    assert warc.archive(frame(spark, [])).count() == 0
