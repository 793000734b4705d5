"""ISO media containers: lossless storage of bytes as raw grey video, and features of any container.

Features come from the boxes alone: nested boxes are walked, the sample tables of the first video
or sound track are decoded, and codec, duration and the byte ranges of its keyframes are kept.
Payloads are never decoded; reading one back only follows the sample tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
GROUP = 12
PER_CHUNK = 8
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def payload_of(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of one frame."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def mux(payload: bytes) -> bytes:
    """A file whose one video track holds payload as uncompressed 24 by 24 frames of 8-bit grey.

    Every 12th frame is listed as a keyframe, where a reader may start. The same payload always gives the same bytes.
    """
    frames = len(payload) // FRAME
    chunks, last = -(-frames // PER_CHUNK), frames % PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (frames >= PER_CHUNK) + [(chunks, last, 1)] * bool(last)
    keys = range(1, frames + 1, GROUP)
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x04grey", 8, -1))

    def moov(start: int) -> bytes:
        offsets = [start + i * PER_CHUNK * FRAME for i in range(chunks)]
        place = full(b"co64", 0, struct.pack(f">I{chunks}Q", chunks, *offsets)) if len(payload) >= 1 << 31 else full(b"stco", 0, struct.pack(f">I{chunks}I", chunks, *offsets))
        stbl = box(
            b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stts", 0, struct.pack(">III", 1, frames, 1)), full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full(b"stsz", 0, struct.pack(">II", FRAME, frames)), place,
        )
        dinf = box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1)))
        minf = box(b"minf", full(b"vmhd", 1, bytes(8)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        trak = box(b"trak", full(b"tkhd", 3, struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16)), mdia)
        return box(b"moov", full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), trak)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    far = len(payload) >= 1 << 31  # then offsets take 8 bytes, whatever they are
    start = len(head) + len(moov(far << 32)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(start) + box(b"mdat", payload)


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, start and end of the body) of every box, parents first. A size that breaks its parent's bounds raises ValueError, as does a nesting of more than 200."""
    end = len(data) if end is None else end
    while start < end:
        if path[-1:] == (b"udta",) and end - start == 4 and not any(data[start:end]):
            return  # such a box may end in a zero word
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,), body = struct.unpack_from(">Q", data, body), start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} ends outside its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            if len(path) >= 200:
                raise ValueError("boxes are nested too deep")
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _counted(data: bytes, at: tuple[int, int], form: str) -> list[tuple]:
    """The rows of a table: a full box with their count before them."""
    (n,) = struct.unpack_from(">4xI", data, at[0])
    width = struct.calcsize(">" + form)
    if at[0] + 8 + n * width > at[1]:
        raise ValueError("a table is cut off")
    return list(struct.iter_unpack(">" + form, data[at[0] + 8 : at[0] + 8 + n * width]))


def _sizes(data: bytes, at: tuple[int, int]) -> list[int]:
    """Sizes of all samples: one for all of them, or 32 bits each."""
    fixed, n = struct.unpack_from(">4xII", data, at[0])
    if not fixed and at[0] + 12 + 4 * n > at[1] or n * max(1, fixed) > len(data):
        raise ValueError("more samples than bytes")
    return [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at[0] + 12))


def _small_sizes(data: bytes, at: tuple[int, int]) -> list[int]:
    """Sizes of 4, 8 or 16 bits each."""
    bits, n = struct.unpack_from(">7xBI", data, at[0])
    body = data[at[0] + 12 : at[1]]
    if bits not in (4, 8, 16) or len(body) * 8 < n * bits:
        raise ValueError("a table is cut off")
    if bits == 16:
        return list(struct.unpack_from(f">{n}H", body))
    return list(body[:n]) if bits == 8 else [x for b in body for x in (b >> 4, b & 15)][:n]


def demux(data: bytes) -> dict:
    """codec, timescale, duration, sizes and offsets of the samples, keys (sample numbers from 0; None: all) of the first track with samples.

    ValueError if data isn't such a container.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    try:
        for path, start, end in walk(data):
            if path == (b"moov", b"trak"):
                tracks.append({})
            elif path[:2] == (b"moov", b"trak") and tracks:
                tracks[-1].setdefault(path[-1], (start, end))
        track = next((t for t in tracks if {b"mdhd", b"stsd", b"stsc"} <= t.keys() and (b"stsz" in t or b"stz2" in t) and (b"stco" in t or b"co64" in t)), None)
        if track is None:
            raise ValueError("no track with sample tables")
        at = track[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">20xIQ" if data[at] else ">12xII", data, at)
        codec = data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16].decode("latin-1")
        sizes = _sizes(data, track[b"stsz"]) if b"stsz" in track else _small_sizes(data, track[b"stz2"])
        n = len(sizes)
        if b"stts" in track:  # durations of runs of samples
            times = _counted(data, track[b"stts"], "II")
            if sum(count for count, _ in times) != n:
                raise ValueError("the sample tables don't agree")
            duration = sum(count * delta for count, delta in times)
        chunks = [x for (x,) in (_counted(data, track[b"co64"], "Q") if b"co64" in track else _counted(data, track[b"stco"], "I"))]
        runs = _counted(data, track[b"stsc"], "III")
        offsets: list[int] = []
        for i, (first, per, _) in enumerate(runs):
            for at in chunks[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)]:
                for _ in range(min(per, n - len(offsets))):
                    offsets.append(at)
                    at += sizes[len(offsets) - 1]
        if len(offsets) != n or any(o + s > len(data) for o, s in zip(offsets, sizes, strict=True)):
            raise ValueError("the sample tables don't agree")
        keys = [x - 1 for (x,) in _counted(data, track[b"stss"], "I") if 0 < x <= n] if b"stss" in track else None
    except struct.error as e:
        raise ValueError("a box is cut off") from e
    return {"codec": codec, "timescale": timescale, "duration": duration, "sizes": sizes, "offsets": offsets, "keys": keys}


def samples(data: bytes, found: dict) -> bytes:
    """The samples' bytes, in order."""
    return b"".join(data[o : o + s] for o, s in zip(found["offsets"], found["sizes"], strict=True))


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text (null: empty) as a container of its UTF-8 bytes, padded to whole frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            start, size, media = 0, 0, []
            raw = [x.encode("utf-8", "replace") for x in batch.column(1).fill_null("").to_pylist()]
            for i, data in enumerate(raw):  # a few MB leave at a time
                media.append(mux(payload_of(data)))
                size += len(data)
                if size > 1 << 22 or i + 1 == len(raw):
                    yield pa.RecordBatch.from_arrays([ids[start : i + 1], pa.array(map(len, raw[start : i + 1]), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    start, size, media = i + 1, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FIELDS = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _features(data: bytes | None) -> dict:
    if data is None:
        return {}
    out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        found = demux(data)
    except ValueError as e:
        return out | {"error": str(e)}
    stored = samples(data, found)
    n = len(found["sizes"])
    ranges = [{"offset": found["offsets"][i], "length": found["sizes"][i]} for i in (found["keys"] if found["keys"] is not None else range(n))]
    listed = zlib.crc32(",".join(f"{r['offset']}+{r['length']}" for r in ranges).encode())
    feature = f"codec={found['codec'].strip()};seconds={found['duration'] / max(1, found['timescale']):.2f};samples={n};keyframes={len(ranges)};ranges_crc32={listed}"
    return out | {
        "codec": found["codec"], "timescale": found["timescale"], "duration": found["duration"], "n_samples": n, "keyframes": ranges,
        "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-32:]), "feature": feature,
    }


def media_features(media: DataFrame, *, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns keep and those of FIELDS for every container in media_col.

    Nulls and empty tables: a null container has null fields. Bytes that are no readable container
    get media_bytes, media_sha256 and error, else nulls; error is null otherwise. Further columns
    are not read. Rows that repeat have equal features.
    """
    kinds = {n.strip().split(" ")[0]: n for n in FIELDS.split(", ")}
    frame = media.select(*keep, F.col(media_col).alias("_media"))
    shape = frame.drop("_media").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        types = {n: pair if n == "keyframes" else pa.int64() if x.endswith(" long") else pa.string() for n, x in kinds.items()}
        for batch in batches:
            rows = [_features(x.as_py()) for x in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], *(pa.array([r.get(n) for r in rows], t) for n, t in types.items())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *types])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema)
    return frame.mapInArrow(run, f"{head}, {FIELDS}")
