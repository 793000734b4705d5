import hashlib
import struct
import zlib

from tapeloom.llm.media import box, demux, media_features, mux, payload_of, samples, to_media, walk


def test_query_against_the_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in media_features(to_media(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = r.text.encode()
        full = raw + b"\xff" * (-len(raw) % 576)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert g.tail_crc32 == zlib.crc32(full[-32:]) and g.error is None
        media = mux(full)
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        for i, k in enumerate(g.keyframes):
            assert media[k.offset : k.offset + k.length] == full[576 * 12 * i :][:576]


def test_round_trip_of_every_shape():
    for n in (0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 576 * 100 + 5):
        payload = payload_of(bytes(i % 251 for i in range(n)))
        found = demux(mux(payload))
        assert samples(mux(payload), found) == payload and len(payload) % 576 == 0 and len(payload) >= 576
        assert found["codec"] == "raw " and found["duration"] == len(payload) // 576
        assert found["keys"] == list(range(0, len(payload) // 576, 12))


def test_boxes_of_other_sizes():
    large = struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd"
    data = box(b"moov", box(b"trak", box(b"free"))) + large + struct.pack(">I4s", 0, b"skip") + b"to the end"
    assert [(b"/".join(p), e - s) for p, s, e in walk(data)] == [(b"moov", 16), (b"moov/trak", 8), (b"moov/trak/free", 0), (b"mdat", 4), (b"skip", 10)]


def test_broken_containers_say_so(spark):
    good = mux(payload_of(b"x" * 5000))
    bad = [None, b"", b"\0\0\0\x08ftyp", good[:200], good[:-100], good.replace(b"stsz", b"free"), b"\0\0\0\x02moov", good]
    rows = media_features(spark.createDataFrame([(i, 0, x) for i, x in enumerate(bad)], "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert rows[0].media_bytes is None and rows[0].error is None
    assert all(r.error and r.codec is None and r.media_bytes is not None for r in rows[1:-1])
    assert rows[-1].error is None and rows[-1].n_samples == 9


def test_odd_rows(spark, odd):
    rows = media_features(to_media(odd)).collect()
    assert len(rows) == 10 and all(r.error is None for r in rows)
    assert {r.n_bytes for r in rows if r.doc_id in (1, 2)} == {0}
    assert media_features(to_media(odd.limit(0))).count() == 0


def test_small_sizes_times_and_zero_ended_user_data():
    import struct

    import pytest

    from tapeloom.llm.media import box, demux, full, samples

    def movie(bits, body, times, end=b"\0\0\0\0"):
        def moov(start):
            stbl = box(
                b"stbl", full(b"stsd", 0, struct.pack(">I", 1), box(b"raw ", bytes(8))), full(b"stts", 0, struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times)),
                full(b"stsc", 0, struct.pack(">IIII", 1, 1, 3, 1)), full(b"stz2", 0, struct.pack(">3xBI", bits, 3), body), full(b"stco", 0, struct.pack(">II", 1, start)),
            )
            mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), box(b"minf", stbl))
            return box(b"moov", box(b"trak", mdia), box(b"udta", box(b"name", b"x"), end))

        return moov(len(moov(0)) + 8) + box(b"mdat", b"abbccc")

    for bits, body in ((4, b"\x12\x30"), (8, b"\1\2\3"), (16, b"\0\1\0\2\0\3")):
        data = movie(bits, body, [(2, 5), (1, 7)])
        found = demux(data)
        assert found["sizes"] == [1, 2, 3] and found["duration"] == 17 and samples(data, found) == b"abbccc"
    for bad in (movie(8, b"\1\2", [(3, 1)]), movie(8, b"\1\2\3", [(2, 1)]), movie(8, b"\1\2\3", [(3, 1)], b"\0\0\0\1"), movie(5, b"\1\2\3", [(3, 1)])):
        with pytest.raises(ValueError):
            demux(bad)
