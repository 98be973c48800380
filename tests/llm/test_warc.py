"""Archives: round trip, rolling, the same bytes again, manifests, damaged files."""
import base64
import gzip
import hashlib
import os

import pytest

from penalytics.llm import warc

ROWS = [(3, "http://a/x y\r\nz", "same"), (1, "http://b/", "same"), (2, None, None), (5, "u", ""), (4, "ü", "é" * 3000),
        (None, "n", "same"), (7, "r", "twice"), (7, "r", "twice"), (8, "long", "x<p>" * 60_000)]


@pytest.fixture()
def pages(spark):
    rows = [(*r, "clash", 1) for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string, records int").repartition(3)


def files(folder):
    path = folder.removeprefix("file:")
    return {n: open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".gz")}


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("roll", [1, 64 << 20])
def test_round_trip(pages, roll):
    folder, manifest = warc.write_archives(pages, roll_bytes=roll)
    found = warc.read_archives(folder, manifest).collect()
    first = {"same": 1, "": 2, "twice": 7}
    expected = []
    for i, _, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t or ""
        revisit = t in first and (i != first[t] or any(e[0] == i and e[4] == digest(t) for e in expected))
        expected.append((i, len(t.encode()), "revisit" if revisit else "response", first[t] if revisit else None, digest(t)))
    key = repr
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in found), key=key) == sorted(expected, key=key)
    assert {bytes(r.payload).decode() for r in found if r.payload is not None} == {t or "" for _, _, t in ROWS}
    listed = {r.file: r for r in manifest.collect()}
    data = files(folder)
    assert set(listed) == set(data) and sum(r.records for r in listed.values()) == len(ROWS)
    assert all(hashlib.sha1(data[n]).hexdigest() == r.sha1 and len(data[n]) == r.compressed_bytes for n, r in listed.items())
    if roll == 1:
        assert all(r.records == 1 for r in listed.values())
    assert gzip.decompress(next(iter(data.values()))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_same_bytes_again(pages):
    one, two = (files(warc.write_archives(p, roll_bytes=2000)[0]) for p in (pages, pages.repartition(5)))
    assert one == two and len(one) > 1


def test_same_files_from_any_partitioning(spark):
    """More rows than any sample of them would hold."""
    made = spark.range(200_000).selectExpr(
        "id * 7 % 200000 as page_id", "concat('http://x/', id) as url", "if(id % 50 = 0, 'again', repeat(md5(string(id)), 1 + int(id % 5))) as html")
    made.write.parquet(folder := warc.scratch_path(spark, "t-pages"))
    rows = spark.read.parquet(folder)
    first, second, third = (warc.write_archives(p, roll_bytes=200_000, part_bytes=2 << 20) for p in (
        rows, rows, rows.repartition(13, "html")))
    listed = [sorted((r.file, r.records, r.sha1) for r in m.collect()) for _, m in (first, second, third)]
    assert listed[0] == listed[1] == listed[2] and len({n.rsplit("-", 1)[0] for n, *_ in listed[0]}) > 5
    assert sum(n for _, n, _ in listed[0]) == 200_000


def test_a_hot_page_id_is_split(spark):
    rows = [(i % 3 * 50 if i % 3 else 7, "u", f"{i} " * 50) for i in range(3000)] + [(None, "u", f"n{i}" * 9) for i in range(300)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest = warc.write_archives(pages, part_bytes=50_000)
    parts = {r.file.rsplit("-", 1)[0] for r in manifest.collect()}
    assert len(parts) > 20
    found = warc.read_archives(folder, manifest).collect()
    want = {}
    for i, _, t in rows:
        want.setdefault((i, digest(t)), []).append(len(t))
    got = {}
    for r in found:
        got.setdefault((r.page_id, r.payload_digest), []).append(r.payload_bytes)
    assert got == want
    assert sum(r.record_type == "revisit" for r in found) == 300
    again = warc.write_archives(pages.repartition(7), part_bytes=50_000)[1]
    assert sorted(r.sha1 for r in again.collect()) == sorted(r.sha1 for r in manifest.collect())


def test_small_payloads_are_all_responses(pages):
    folder, manifest = warc.write_archives(pages, least_bytes=5)
    found = {(r.page_id, r.record_type) for r in warc.read_archives(folder, manifest).collect()}
    assert (3, "response") in found and (5, "response") in found and (7, "revisit") in found


def test_damage_is_found(pages):
    folder, manifest = warc.write_archives(pages)
    name = manifest.orderBy("file").first()["file"]
    path = os.path.join(folder.removeprefix("file:"), name)
    plain = gzip.decompress(open(path, "rb").read())
    crc = os.path.join(os.path.dirname(path), f".{name}.crc")
    assert not os.path.exists(crc)
    with open(path, "wb") as f:
        f.write(gzip.compress(plain.replace(b"same", b"sama")))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(folder, manifest).collect()


def test_empty(spark):
    folder, manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc.read_archives(folder, manifest).count() == 0
