import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from gaugeworks.llm import archives

BIG, BIG2 = "é" * 600, "<p>" * 400


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}?q=ü", t) for i, t in enumerate([None, "", "short", "short", BIG, "x" * 3000, BIG, BIG2, BIG, BIG2, "z" * 999, "z" * 999])]
    rows += [(8, "http://b.example/", BIG), (None, None, BIG2), (None, "bad\r\nurl", "tiny")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS revisit").repartition(3)


def test_round_trip(pages):
    got = archives.read(archives.write(pages, archive_bytes=2000)).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    last = {}
    for i, p in rows:
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    want = [(i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", last[p]) if last.get(p, i) != i else ("response", None))) for i, p in rows]
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(repr, want))
    assert sorted(bytes(r["payload"]) for r in got if r["record_type"] == "response") == sorted(p for i, p in rows if last.get(p, i) == i)


def test_no_pages(spark):
    manifest = archives.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0
    assert archives.read(manifest).count() == 0


class File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def packed(members, comment=b""):
    out = File()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(data)
    return out


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment" * 50])
def test_directories(monkeypatch, zip64, comment):
    """With the limits lowered the writer needs ZIP64 fields for sizes, offsets and counts."""
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    members = {f"é{i}.bin": bytes([i]) * (10 + 30 * i) for i in range(5)}
    f = packed(members, comment)
    got = archives.directory(f)
    assert [m.name for m in got] == list(members)
    for m in got:
        f.seek(archives.data_offset(f, m))
        assert f.read(m.size) == members[m.name]


def test_broken_archives():
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.directory(File(b"no archive at all"))
    out = File()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"aaaa" * 100)
    with pytest.raises(ValueError, match="compressed"):
        archives.data_offset(out, archives.directory(out)[0])


def test_paths_of_the_shared_folder():
    for path in ("file:/tmp/a", "file:///tmp/a"):
        store, name = archives.open_shared(path)
        assert isinstance(store, pa.fs.LocalFileSystem)
        assert name == "/tmp/a"
