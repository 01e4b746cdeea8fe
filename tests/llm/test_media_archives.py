import hashlib
import io
import random
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftprint.llm import mpeg, shared, warc


@given(st.binary(max_size=5000))
@settings(max_examples=100, deadline=None)
def test_audio_round_trip(payload):
    payload, s = mpeg.decode(mpeg.encode(payload))[0], mpeg.parse(mpeg.encode(payload))
    assert mpeg.decode(mpeg.encode(payload))[0] == payload
    assert s.skipped == 0 and s.bad_crc == 0 and s.table["kind"] == "Xing" and s.table["frames"] == len(s.offsets)
    assert s.duration == (1152 * len(s.offsets), 48000 if s.offsets else 1)


def frame(kbps_index=9, rate_index=0, version=3, layer=3, pad=0, mono=True, crc=False, body=0):
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | (not crc) << 16 | kbps_index << 12 | rate_index << 10 | pad << 9 | (3 if mono else 0) << 6
    h = mpeg.header(word)
    data = bytearray(word.to_bytes(4, "big") + bytes([body]) * (h.length - 4))
    if crc:
        data[4:6] = mpeg.crc16(bytes(data[2:4] + data[6 : 6 + h.side])).to_bytes(2, "big")
    return bytes(data)


def test_header_values():
    # known frames: length and samples
    for args, length, samples in ((dict(), 417, 1152), (dict(pad=1), 418, 1152), (dict(version=2), 261, 576), (dict(layer=2), 522, 1152), (dict(layer=1), 312, 384), (dict(version=0, rate_index=2), 720, 576)):
        f = frame(**args)
        h = mpeg.header(int.from_bytes(f[:4], "big"))
        assert (h.length, h.samples) == (length, samples)
    assert all(mpeg.header(w) is None for w in (0, 0xFFFBF000, 0xFFFB0000, 0xFFEB9000, 0xFFF99000, 0xFFFB9C00, 0xFFFB9002))
    assert mpeg.crc16(b"123456789") == 0xAEE7


def test_resynchronises():
    good = [frame(crc=True, pad=i % 2) for i in range(8)]
    junk = b"\xff\xfb\x90\x00 not a frame \xff\xff\xfb" * 3
    tag = b"ID3\x03\x00\x00\x00\x00\x00\x11TIT2\x00\x00\x00\x07\x00\x00\x00Title!"
    old = b"TAG" + b"Old".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    data = tag + junk + b"".join(good[:4]) + junk + b"".join(good[4:]) + old
    s = mpeg.parse(data)
    assert len(s.offsets) == 8 and s.skipped == 2 * len(junk) and s.checked == 8 and s.bad_crc == 0
    assert all(data[o : o + len(f)] == f for o, f in zip(s.offsets, good, strict=True))
    assert s.tags["TIT2"] == "Title!" and s.tags["title"] == "Old" and s.tags["artist"] == "Artist"
    assert s.duration == (8 * 1152, 44100) and s.seek(0) == s.offsets[0] and s.seek(1152 * 5 + 1) == s.offsets[5]
    with pytest.raises(ValueError):
        s.seek(8 * 1152)
    broken = bytearray(data)
    broken[s.offsets[2] + 8] ^= 1  # side information
    assert mpeg.parse(bytes(broken)).bad_crc == 1


def test_vbri_and_nothing():
    f = bytearray(frame(11, mono=False))
    f[36:62] = b"VBRI" + bytes(6) + (9999).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\3"
    f[62:66] = (100).to_bytes(2, "big") + (200).to_bytes(2, "big")
    s = mpeg.parse(bytes(f) + frame(11, mono=False) * 5)
    assert s.table == {"kind": "VBRI", "bytes": 9999, "frames": 5, "per_entry": 3, "toc": [100, 200]} and len(s.offsets) == 5
    for data in (b"", b"\xff" * 500, b"RIFF" + bytes(900), frame()[:-1]):
        assert mpeg.parse(data).duration == (0, 1)


def test_damage_is_found():
    data = bytearray(mpeg.encode(b"x" * 3000))
    data[mpeg.parse(bytes(data)).offsets[1] + 10] ^= 4
    with pytest.raises(ValueError):
        mpeg.decode(bytes(data))


@pytest.mark.parametrize("word", [b"TAG", b"ID3", b"Xing", b"Info", b"VBRI", b"\xff\xfb\x90\xc4", mpeg.encode(b"")[-192:-150]])
def test_payloads_that_look_like_the_format(word):
    for size in (192, 960, 1920, 2880, 3648):  # one to four frames
        for at in range(0, size - len(word) + 1, 1 if size < 2000 or word == b"TAG" else 7):
            payload = b"x" * at + word + b"y" * (size - at - len(word))
            assert mpeg.decode(mpeg.encode(payload))[0] == payload, (size, at)


def test_text_with_tag_before_the_end(spark):
    texts = ["x" * at + "TAG" + "y" * 50 for at in range(80, 100)]
    rows = mpeg.features(mpeg.store(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()
    check_media(rows, list(enumerate(texts)))


def test_tag_after_a_frame_that_is_cut_off():
    data = b"".join(frame() for _ in range(4)) + frame()[:200] + b"TAG" + b"T".ljust(125, b"\0")
    s = mpeg.parse(data)
    assert len(s.offsets) == 4 and s.tags["title"] == "T"


def check_media(rows, docs):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    want = Counter()
    for doc, text in docs:
        raw = (text or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert got == want
    by = {}
    for r in rows:  # equal payloads, equal values
        assert by.setdefault(r.payload_sha256, r[5:]) == r[5:]
        assert r.media_bytes >= r.payload_bytes and len(r.seek_offsets) * 1152 == r.duration_samples


def test_media_column(spark, small, awkward, awkward_rows, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_media(mpeg.features(mpeg.store(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_media(mpeg.features(mpeg.store(awkward)).collect(), [(d, t) for d, t, *_ in awkward_rows])
    assert mpeg.features(mpeg.store(empty)).count() == 0


def test_warc_against_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    rel = duckdb.sql(warc.SQL)
    want = Counter(map(tuple, rel.fetchall()))
    got = warc.archive_and_read(spark.read.parquet(f"{small}/pages.parquet"))
    assert Counter(map(tuple, got.select(*rel.columns).collect())) == want


def awkward_pages():
    rng = random.Random(3)
    body = ["<html>" + "x" * rng.randint(0, 200) + str(i % 7) + "é" * 60 for i in range(7)]
    rows = [(i, f"https://h{i % 5}.example.org:443/a?b={i % 3}#c", rng.choice(body)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x.y/\r\nEvil: 1", "short"), (103, "http://x.y/", "short"), (104, "no scheme", body[0]), (None, "http://x.y/", body[0]), (3, "http://again/", rows[3][2]), (3, "http://again/", rows[3][2]), (105, "http://ü.example/ü", "\r\n\r\nWARC/1.1\r\n" * 20)]
    return rows


def test_warc_awkward(spark):
    rows = awkward_pages()
    df = spark.createDataFrame([(*r, "?", 1) for r in rows], "page_id bigint, url string, html string, digest string, first int").repartition(4)
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        again = page is not None and page > first.get(html, page)
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None] += 1
    assert Counter(map(tuple, warc.archive_and_read(df).collect())) == want
    assert warc.archive_and_read(df.where("false")).count() == 0


def test_warc_record_ids(spark, tmp_path):
    base = f"file://{tmp_path}"
    shared.make_dirs(spark, f"{base}/a")
    rows = awkward_pages()
    warc.write(spark.createDataFrame(rows * 2, "page_id bigint, url string, html string").repartition(4), f"{base}/a").count()
    ids, refers = [], set()
    for p in (tmp_path / "a").glob("*.warc.gz"):
        with open(p, "rb") as f:
            for h, _ in map(warc.decode_record, warc.members(f)):
                ids.append(h["WARC-Record-ID"])
                refers.add(h.get("WARC-Refers-To"))
    assert len(ids) == len(set(ids)) == 2 * len(rows)
    assert refers - {None} <= set(ids) and len(refers) > 5


def test_warc_index(spark, tmp_path):
    base = f"file://{tmp_path}"
    shared.make_dirs(spark, f"{base}/a", f"{base}/i")
    pages = spark.createDataFrame([r for r in awkward_pages() if r[0] is not None], "page_id bigint, url string, html string").dropDuplicates(["page_id"]).repartition(3)
    captures = warc.write(pages, f"{base}/a")
    top = warc.build_index(captures, f"{base}/i", lines=4)
    index = warc.CaptureIndex(top, f"{base}/i", f"{base}/a", kept=2)
    rows = captures.collect()
    for c in rows:
        found = index.find(c.url, c.page_id)
        assert found[1:] == [c.page_id, c.url, c.kind, c.digest, c.file, c.offset, c.length]
        headers, payload = index.read(found)
        assert headers["WARC-Target-URI"] == c.url and int(headers["X-Page-Id"]) == c.page_id
        assert c.kind == "revisit" or hashlib.sha256(payload).hexdigest() == c.digest
    assert index.find("http://nowhere.example/", 1) is None and index.find(rows[0].url, 10**9) is None
    keys = [k for k, _, _ in top]
    assert keys == sorted(keys) and sum(p.suffix == ".gz" for p in (tmp_path / "a").iterdir()) == captures.select("file").distinct().count()


@pytest.mark.parametrize("uri,key", [("http://www.Example.com/a?b#c", "com,example,www)/a?b"), ("https://u@x.org:443", "org,x)/"), ("http://x.org:8080/p", "org,x:8080)/p"), ("urn:page:3", "urn:page:3")])
def test_host_key(uri, key):
    assert warc.host_key(uri) == key


def test_torn_archive():
    data = warc._gzip(b"one") + warc._gzip(b"two" * 1000)
    assert list(warc.members(io.BytesIO(data), 7)) == [b"one", b"two" * 1000]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        warc.decode_record(b"HTTP/1.1 200 OK\r\n\r\n")
