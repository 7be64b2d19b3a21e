"""Media columns: ISO base media containers, written and walked box by box.

media_columns() writes payloads as fixed-size samples of one track and reads them back; read_media() reads a column of files of any
origin. The walker decodes each track's own sample tables (stsd, mdhd, stts, stsc, stsz/stz2, stco/co64, stss) and
fragments (trex, tfhd, trun) of nested boxes and derives codec, duration and the byte ranges of keyframes; it never touches
the media data itself.

Nulls and empty texts are one sample of spaces; any length works (64-bit box sizes and offsets are
written when needed); repeated rows give repeated values; an empty table gives an empty table. Only
doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import field, with_columns

SAMPLE = 192
SAMPLES_PER_CHUNK = 64
KEYFRAME_EVERY = 16
TIMESCALE = 8000
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, sample: int = SAMPLE, codec: bytes = b"raw ", timescale: int = TIMESCALE) -> bytes:
    """An ISO media file with payload (a positive multiple of sample bytes) as unsigned 8-bit PCM samples."""
    if not payload or len(payload) % sample:
        raise ValueError("payload must be a positive multiple of the sample size")
    n = len(payload) // sample
    duration = n * sample  # one tick per 8-bit sample
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    head = struct.pack(">I4s", len(payload) + 8, b"mdat") if len(payload) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    first = len(ftyp) + len(head)
    chunks = [first + i * sample for i in range(0, n, SAMPLES_PER_CHUNK)]
    wide = chunks[-1] >= 1 << 32
    stco = _full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks))
    last = n - (len(chunks) - 1) * SAMPLES_PER_CHUNK
    runs = [(1, min(n, SAMPLES_PER_CHUNK), 1)]
    if len(chunks) > 1 and last != SAMPLES_PER_CHUNK:
        runs.append((len(chunks), last, 1))
    keys = list(range(1, n + 1, KEYFRAME_EVERY))
    entry = _box(codec, bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, timescale << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, 0, struct.pack(">III", 1, n, sample)),
        _full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", 0, 0, struct.pack(">II", sample, n)),
        stco,
    )
    matrix = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    mdhd = _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, timescale, duration, 0x55C4, 0))
    hdlr = _full(b"hdlr", 0, 0, struct.pack(">I4s12s", 0, b"soun", b""), b"samples\0")
    dinf = _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1)))
    minf = _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), dinf, stbl)
    tkhd = _full(b"tkhd", 1, 7, struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, duration, 0, 0, 256, 0), matrix, bytes(8))
    mvhd = _full(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, timescale, duration, 65536, 256), matrix, bytes(24), struct.pack(">I", 2))
    moov = _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))
    return b"".join((ftyp, head, payload, moov))


def walk(blob: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, nested ones after the box that holds them."""
    end = len(blob) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", blob, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", blob, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(blob, body, stop, (*path, kind))
        start = stop


def _numbers(blob: bytes, at: int, count: int, kind: str) -> tuple[int, ...]:
    return struct.unpack_from(f">{count}{kind}", blob, at)


def _compact_sizes(blob: bytes, a: int) -> list[int]:
    """Of a stz2 box: sizes of 4, 8 or 16 bits."""
    width, count = blob[a + 7], struct.unpack_from(">I", blob, a + 8)[0]
    if width == 4:
        return [blob[a + 12 + i // 2] >> (4 if i % 2 == 0 else 0) & 15 for i in range(count)]
    return list(_numbers(blob, a + 12, count, {8: "B", 16: "H"}[width]))


def _table(blob: bytes, kind: bytes, a: int) -> tuple[str, object] | None:
    """What a box of a track's tables says."""
    count = struct.unpack_from(">I", blob, a + 4)[0] if kind in (b"stts", b"stss", b"stsc", b"stco", b"co64", b"stsd") else 0
    if kind == b"mdhd":
        return "clock", struct.unpack_from(">IQ" if blob[a] else ">II", blob, a + (20 if blob[a] else 12))
    if kind == b"tkhd":
        return "id", struct.unpack_from(">I", blob, a + (20 if blob[a] else 12))[0]
    if kind == b"stsd":
        return "codec", blob[a + 12 : a + 16].decode("latin-1") if count else ""
    if kind == b"stts":
        return "times", [struct.unpack_from(">II", blob, a + 8 + 8 * i) for i in range(count)]
    if kind == b"stss":
        return "keys", _numbers(blob, a + 8, count, "I")
    if kind == b"stsc":
        return "runs", [struct.unpack_from(">III", blob, a + 8 + 12 * i) for i in range(count)]
    if kind == b"stsz":
        fixed, count = struct.unpack_from(">II", blob, a + 4)
        return "sizes", [fixed] * count if fixed else list(_numbers(blob, a + 12, count, "I"))
    if kind == b"stz2":
        return "sizes", _compact_sizes(blob, a)
    if kind in (b"stco", b"co64"):
        return "chunks", _numbers(blob, a + 8, count, "I" if kind == b"stco" else "Q")
    return None


def _sample_ranges(track: dict) -> list[tuple[int, int]]:
    out, runs, sizes, k = [], track.get("runs", []), track.get("sizes", []), 0
    for i, at in enumerate(track.get("chunks", ()) if runs else (), 1):
        while k + 1 < len(runs) and runs[k + 1][0] <= i:
            k += 1
        for size in sizes[len(out) : len(out) + runs[k][1]]:
            out.append((at, at + size))
            at += size
    return out


def _fragment(blob: bytes, start: int, body: int, end: int, track: dict, defaults: tuple[int, int, int]) -> None:
    """Adds the samples that a moof box gives the track: ranges, durations and whether they are keyframes."""
    follows = start  # where data goes on that no run places
    for path, a, b in walk(blob, body, end):
        if path != (b"traf",):
            continue
        boxes = [(p[-1], x) for p, x, _ in walk(blob, a, b)]
        header = next((x for kind, x in boxes if kind == b"tfhd"), None)
        if header is None:
            continue
        flags, track_id = struct.unpack_from(">II", blob, header)
        base, at, (duration, size, kept) = start, header + 8, defaults
        if flags & 1:
            base, at = struct.unpack_from(">Q", blob, at)[0], at + 8
        at += 4 * bool(flags & 2)
        given = []
        for bit in (8, 16, 32):
            given.append(struct.unpack_from(">I", blob, at)[0] if flags & bit else None)
            at += 4 * bool(flags & bit)
        duration, size, kept = (x if x is not None else y for x, y in zip(given, (duration, size, kept), strict=True))
        here = base if flags & 0x20001 else follows
        for kind, x in boxes:
            if kind != b"trun":
                continue
            flags, count = struct.unpack_from(">I", blob, x)[0] & 0xFFFFFF, struct.unpack_from(">I", blob, x + 4)[0]
            at = x + 8
            if flags & 1:
                here, at = base + struct.unpack_from(">i", blob, at)[0], at + 4
            first = struct.unpack_from(">I", blob, at)[0] if flags & 4 else None
            at += 4 * bool(flags & 4)
            for i in range(count):
                got = []
                for bit in (0x100, 0x200, 0x400, 0x800):
                    got.append(struct.unpack_from(">I", blob, at)[0] if flags & bit else None)
                    at += 4 * bool(flags & bit)
                length = got[1] if got[1] is not None else size
                mark = first if i == 0 and first is not None else got[2] if got[2] is not None else kept
                if track_id == track["id"]:
                    track["ranges"].append((here, here + length))
                    track["duration"] += got[0] if got[0] is not None else duration
                    if not mark & 0x10000:
                        track["key_ranges"].append((here, here + length))
                here += length
        follows = here


def read_tracks(blob: bytes) -> list[dict]:
    """id, codec, timescale, duration, sample byte ranges and keyframe byte ranges of every track, from their own tables and from fragments.
    A track without tables for its samples has none; one without a table of keyframes has only keyframes."""
    tracks: list[dict] = []
    extends: dict[int, tuple[int, int, int]] = {}
    fragments = []
    for path, a, b in walk(blob):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and (found := _table(blob, path[-1], a)):
            tracks[-1].setdefault(*found)
        elif path == (b"moov", b"mvex"):
            for inner, x, _ in walk(blob, a, b):
                if inner == (b"trex",):
                    track_id, _, *defaults = struct.unpack_from(">5I", blob, x + 4)
                    extends[track_id] = tuple(defaults)
        elif path == (b"moof",):
            long = a >= 16 and struct.unpack_from(">I", blob, a - 16)[0] == 1 and blob[a - 12 : a - 8] == b"moof"
            fragments.append((a - (16 if long else 8), a, b))
    for track in tracks:
        track["timescale"], track["duration"] = track.pop("clock", (0, 0))
        track["codec"], track["id"] = track.get("codec", ""), track.get("id", 0)
        track["ranges"] = _sample_ranges(track)
        keys = track.get("keys")
        track["key_ranges"] = list(track["ranges"]) if keys is None else [track["ranges"][i - 1] for i in keys if 0 < i <= len(track["ranges"])]
        for start, a, b in fragments:
            _fragment(blob, start, a, b, track, extends.get(track["id"], (0, 0, 0)))
    return tracks


def read_track(blob: bytes) -> dict:
    """The first track; see read_tracks."""
    tracks = read_tracks(blob)
    if not tracks:
        raise ValueError("no track")
    return tracks[0]


def payload_of(text: str | None, sample: int = SAMPLE) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // sample)) * sample, b" ")


def describe(blob: bytes) -> tuple[bytes, str, list[int]]:
    """The stored samples, a one-line feature and the flat list of keyframe ranges of a container."""
    track = read_track(blob)
    stored = b"".join(blob[a:b] for a, b in _joined(track["ranges"]))
    keys = [x for pair in track["key_ranges"] for x in pair]
    table = zlib.crc32(struct.pack(f"<{len(keys)}Q", *keys))
    feature = f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['ranges'])};keyframes={len(track['key_ranges'])};keyframe_crc={table:08x}"
    return stored, feature, keys


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def read_media(files: DataFrame, column: str = "media") -> DataFrame:
    """files with codec, timescale, duration, n_samples and key_ranges (starts and ends, flat) of the first track, and problem: why a file
    can't be read, with the others null. A null file has all of them null. Columns of these names must not be there already."""

    def run(blobs):
        cols: list[list] = [[] for _ in range(6)]
        for blob in blobs.to_pylist():
            row: tuple = (None,) * 6
            if blob is not None:
                try:
                    t = read_track(blob)
                    row = (t["codec"], t["timescale"], t["duration"], len(t["ranges"]), [x for pair in t["key_ranges"] for x in pair], None)
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    row = (*[None] * 5, f"{type(e).__name__}: {e}")
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    return with_columns(files, run, [column], [field("codec", "string"), field("timescale", "long"), field("duration", "long"), field("n_samples", "long"), field("key_ranges", "array<long>"), field("problem", "string")])


def media_columns(docs: DataFrame, sample: int = SAMPLE, keep_media: bool = True) -> DataFrame:
    """doc_id, media (the container), n_bytes, payload_bytes, digests of what was read back, feature and key_ranges."""

    def run(_, texts):
        cols: list[list] = [[] for _ in range(9 if keep_media else 8)]
        for text in texts.to_pylist():
            n, payload = payload_of(text, sample)
            blob = write_container(payload, sample)
            stored, feature, keys = describe(blob)
            row = (n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, keys)
            for c, v in zip(cols, (*row, blob) if keep_media else row, strict=True):
                c.append(v)
        return cols

    fields = [field("n_bytes", "long"), field("payload_bytes", "long"), field("payload_sha256", "string"), field("tail_crc32", "long"), field("media_bytes", "long"), field("media_sha256", "string"), field("feature", "string"), field("key_ranges", "array<long>")]
    if keep_media:
        fields.append(field("media", "binary"))
    return with_columns(docs.select("doc_id", "text"), run, ["doc_id", "text"], fields).drop("text")
