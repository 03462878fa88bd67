"""GIF media columns: an LZW decoder and encoder, compositing, and per-frame features.

The decoder reads any GIF87a or GIF89a stream: global and local palettes, interlacing,
transparency, delays and the four disposal rules. LZW codes are unpacked in bulk, since
between clear codes the width of a code follows from its place alone. `store_text` writes a
payload as timed 24 x 24 frames of palette indices and reads them back.

Defined cases: null or empty text is the 576-byte payload of 255s. Rows repeat as they come;
equal texts give equal values. An empty table gives an empty table. A stream that ends early
gives its whole frames and, of the last one, what could be read, padded with index 0. Bytes
that aren't a GIF give no frames. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 24
FRAME = SIDE * SIDE
#: Hundredths of a second that a stored frame is shown, and bins of the histogram column for each of red, green and blue.
DELAY, BINS = 10, 16
_GRAY = bytes(v for v in range(256) for _ in range(3))

STORED_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
FRAME_SCHEMA = "media_id long, frame int, delay_ms int, width int, height int, disposal int, rgba binary, histogram array<long>"


def code_widths(count: int, bits: int) -> np.ndarray:
    """Widths of the codes behind a clear code, in order: the table grows by one with each code but the first."""
    size = (1 << bits) + 2 + np.maximum(0, np.arange(count) - 1)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(size)).astype(np.int64) + 1))


_WIDTHS = {bits: code_widths(4097, bits) for bits in range(2, 9)}


def lzw_codes(data: bytes, bits: int = 8) -> list[list[int]]:
    """Greedy LZW codes of `data`, a list for each stretch that begins with a clear code."""
    clear = 1 << bits
    stretches, codes, table, free = [], [], {}, clear + 2
    get = table.get
    if not data:
        return [[]]
    word = data[0]
    for byte in data[1:]:
        key = word << 8 | byte
        known = get(key)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[key] = free
        free += 1
        word = byte
        if free == 4096:
            stretches.append(codes)
            codes, free = [], clear + 2
            table.clear()
    codes.append(word)
    stretches.append(codes)
    return stretches


def _packed(values: np.ndarray, starts: np.ndarray, size: int) -> bytes:
    """Values put at bit positions, lowest bits first."""
    at, moved = starts >> 3, values.astype(np.int64) << (starts & 7)
    out = np.zeros(size + 3)
    for k in range(3):
        out[k : size + k] += np.bincount(at, (moved >> (8 * k)) & 255, size)
    return out[:size].astype(np.uint8).tobytes()


def lzw_codes_side_by_side(frames: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The same codes for many frames (rows) of one small size: all codes in order, and their number per frame.

    Every frame is a lane; a step reads one pixel of each. The lanes' tables share one hash
    table with linear probing. Frames are small enough never to fill a code table.
    """
    lanes, pixels = frames.shape
    clear = 1 << bits
    assert clear + 2 + pixels <= 4096 and lanes * (clear + 2 + pixels) << bits < 1 << 62
    slots = 1 << int(2 * lanes * pixels).bit_length()
    keys, values, mask = np.full(slots, -1, np.int64), np.zeros(slots, np.int16), slots - 1
    shift = np.uint64(64 - (slots.bit_length() - 1))
    columns = np.ascontiguousarray(frames.T).astype(np.int64)
    base = np.arange(lanes, dtype=np.int64) * (clear + 2 + pixels) << bits
    word, count = columns[0].copy(), np.zeros(lanes, np.int64)
    codes = np.zeros((lanes, pixels), np.int16)
    for k in range(1, pixels):
        key = base + (word << bits) + columns[k]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        there = keys[slot]
        astray = np.flatnonzero((there != key) & (there != -1))
        while len(astray):
            slot[astray] = (slot[astray] + 1) & mask
            there[astray] = keys[slot[astray]]
            astray = astray[(there[astray] != key[astray]) & (there[astray] != -1)]
        known = there == key
        new = np.flatnonzero(~known)
        codes[new, count[new]] = word[new]
        todo = new
        while len(todo):  # of lanes that chose the same free slot one gets it, the others go on
            free = keys[slot[todo]] == -1
            took = todo[free]
            keys[slot[took]] = key[took]
            todo = todo[keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        values[slot[new]] = clear + 2 + count[new]
        count[new] += 1
        word = np.where(known, values[slot], columns[k])
    codes[np.arange(lanes), count] = word
    count += 1
    return codes[np.arange(pixels) < count[:, None]].astype(np.int64), count


#: Frames encoded side by side: bounds the hash table.
LANES = 4096


def lzw_streams(frames: list[bytes], bits: int = 8) -> list[bytes]:
    """LZW streams of several frames."""
    small = len(frames) > 8 and len({len(f) for f in frames}) == 1 and 0 < len(frames[0]) <= 2048
    if small:
        out = []
        for k in range(0, len(frames), LANES):
            part = frames[k : k + LANES]
            grid = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1)
            out += _streams(*lzw_codes_side_by_side(grid, bits), bits)
        return out
    return [_stream(lzw_codes(f, bits), bits) for f in frames]


def _stream(stretches: list[list[int]], bits: int) -> bytes:
    """One stream, with a clear code before each stretch."""
    clear, table = 1 << bits, _WIDTHS[bits]
    values, widths, width = [], [], bits + 1
    for codes in stretches:
        values += [clear, *codes]
        widths += [[width], table[: len(codes)]]
        width = int(table[len(codes)])
    values.append(clear + 1)
    width = np.concatenate([*widths, [width]]).astype(np.int64)
    ends = np.cumsum(width)
    return _packed(np.asarray(values), ends - width, -(-int(ends[-1]) // 8))


def _streams(codes: np.ndarray, counts: np.ndarray, bits: int) -> list[bytes]:
    """Streams of one stretch each."""
    clear, table = 1 << bits, _WIDTHS[bits]
    before = np.concatenate([[0], np.cumsum(table)]) + bits + 1  # bits before the k-th code
    first = np.cumsum(counts) - counts
    place = np.arange(len(codes)) - np.repeat(first, counts)
    sizes = -(-(before[counts] + table[counts]) // 8)
    offsets = np.cumsum(sizes) - sizes
    starts = np.concatenate([before[place] + np.repeat(offsets * 8, counts), offsets * 8, offsets * 8 + before[counts]])
    values = np.concatenate([codes, np.full(len(counts), clear), np.full(len(counts), clear + 1)])
    data = _packed(values, starts, int(sizes.sum()))
    return [data[a : a + n] for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]


def expand(codes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The indices that stretches of codes stand for, all stretches at once.

    The entry that a code added is its own string and the first index of the next code's. So a
    code above the literals is one longer than the code that added its entry, its parent; and
    its index at place o is the first index of the code behind the ancestor of length o.
    """
    n, top = len(codes), (1 << bits) + 2
    first_of = np.repeat(np.cumsum(counts) - counts, counts)
    literal = codes < top
    parent = np.where(literal, np.arange(n), first_of + codes - top)
    if (parent >= np.arange(n) + literal).any():
        raise ValueError("a code that is not there yet")
    depth, root = np.where(literal, 0, 1), parent.copy()
    while (depth[root] > 0).any():  # pointer doubling
        depth = depth + depth[root]
        root = root[root]
    lengths, first = depth + 1, codes[root]
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[ends - lengths] = first
    active = np.flatnonzero(~literal)
    at, place = active, ends[active] - 1
    while len(active):
        at = parent[at]
        out[place] = first[at + 1]
        place = place - 1
        more = ~literal[at]
        active, at, place = active[more], at[more], place[more]
    return out


def _unpack(raw: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    byte = starts >> 3
    return ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7)) & ((1 << widths) - 1)


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """At most `most` palette indices from any code stream, stretch by stretch; a broken code ends it."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    whole, at, out, got = 8 * len(data), 0, [], 0
    while got < most:
        # All codes up to the next clear code, the end code or the end of the data.
        room = (whole - at) // (bits + 1)
        width = _WIDTHS[bits][:room] if room <= 4097 else np.concatenate([_WIDTHS[bits], np.full(room - 4097, 12)])
        ends = at + np.cumsum(width)
        ends = ends[ends <= whole]
        width = width[: len(ends)]
        codes = _unpack(raw, ends - width, width)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        here = int(marks[0]) if len(marks) else len(codes)
        part = codes[:here]
        # Codes of entries not there yet, and entries beyond a full table, are errors.
        late = np.flatnonzero(part - (clear + 2) >= np.minimum(np.arange(here), 4094 - clear))
        sound = part[: int(late[0])] if len(late) else part
        if len(sound):
            out.append(expand(sound, np.asarray([len(sound)]), bits).tobytes())
            got += len(out[-1])
        if len(late) or here == len(codes) or codes[here] == stop:
            break
        at = int(ends[here])
    return b"".join(out)[:most]


def decode_streams(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Palette indices of several (stream, code bits, pixels). Whole streams of one stretch go together."""
    out: list[bytes | None] = [None] * len(streams)
    for bits in {b for _, b, _ in streams}:
        mine = [k for k, (_, b, _) in enumerate(streams) if b == bits]
        if len(mine) > 4:
            for k, pixels in zip(mine, _together([streams[k][0] for k in mine], np.asarray([streams[k][2] for k in mine]), bits), strict=True):
                out[k] = pixels
    return [lzw_decode(*streams[k]) if pixels is None else pixels for k, pixels in enumerate(out)]


def _together(streams: list[bytes], pixels: np.ndarray, bits: int) -> list[bytes | None]:
    clear, stop, table = 1 << bits, (1 << bits) + 1, _WIDTHS[bits]
    ends = np.cumsum(table[:4096]) + bits + 1
    sizes = np.asarray([len(s) for s in streams])
    counts = np.searchsorted(ends, 8 * sizes, "right")  # codes behind the first
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    width = table[place]
    codes = _unpack(raw, np.repeat(base, counts) + ends[place] - width, width)
    leads = (sizes >= 2) & (_unpack(raw, np.minimum(base, 8 * (len(raw) - 3)), np.full(len(sizes), bits + 1)) == clear)
    # The first mark of each must be the end code, and every code of an entry that is there.
    owner = np.repeat(np.arange(len(sizes)), counts)
    marks = np.flatnonzero((codes == clear) | (codes == stop))
    has, which = np.unique(owner[marks], return_index=True)
    mark = np.zeros(len(sizes), np.int64)
    mark[has] = place[marks[which]]
    good = np.zeros(len(sizes), bool)
    good[has] = codes[marks[which]] == stop
    good &= leads & (mark > 0)
    kept = place < np.repeat(mark, counts)
    late = kept & (codes - (clear + 2) >= np.minimum(place, 4094 - clear))
    good[owner[late]] = False
    kept &= good[owner]
    lengths = np.where(good, mark, 0)
    out = expand(codes[kept], lengths[good], bits) if good.any() else np.zeros(0, np.uint8)
    # How many indices each stream gave: codes' lengths add up by stream; whole frames have `pixels` of them.
    if len(out) != int(pixels[good].sum()):
        return [None] * len(streams)
    data, at, result = out.tobytes(), 0, []
    for ok, n in zip(good.tolist(), pixels.tolist(), strict=True):
        result.append(data[at : at + n] if ok else None)
        at += n * ok
    return result


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[k : k + 255])]) + p for k in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[bytes], width: int = SIDE, height: int = SIDE, palette: bytes = _GRAY, delay: int = DELAY) -> bytes:
    """A GIF of full-canvas frames of indices into one palette of 256 colours, each shown for `delay` hundredths of a second."""
    return gif_of(lzw_streams(frames), width, height, palette, delay)


def gif_of(streams: list[bytes], width: int = SIDE, height: int = SIDE, palette: bytes = _GRAY, delay: int = DELAY) -> bytes:
    """A GIF of full-canvas frames from their code streams."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    head = b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    for stream in streams:
        out += (head, _blocks(stream))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay: int


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames as stored."""
    return read_gifs([data])[0]


def read_gifs(many: list[bytes]) -> list[tuple[int, int, list[Frame]]]:
    """The same for several GIFs, whose code streams are decoded together."""
    parsed = [_parse(data) for data in many]
    streams = [(f.indices, bits, f.width * f.height) for _, _, found in parsed for f, bits, _ in found]
    pixels = iter(decode_streams(streams))
    for _, _, found in parsed:
        for f, _, interlaced in found:
            grid = np.frombuffer(next(pixels).ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
            if interlaced:
                h = f.height
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                woven = np.empty_like(grid)
                woven[rows] = grid
                grid = woven
            f.indices = grid
    return [(w, h, [f for f, _, _ in found]) for w, h, found in parsed]


def _parse(data: bytes) -> tuple[int, int, list[tuple[Frame, int, bool]]]:
    """Canvas size and frames whose indices are still code streams, with their code bits and whether rows are interlaced."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return 0, 0, []
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        size = 3 << ((flags & 7) + 1)
        raw = data[at : at + size]
        return np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3), at + size

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = colours(at, flags)
    frames, transparent, disposal, delay = [], None, 0, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21 and at < len(data):
            label, (body, at) = data[at], joined(at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 9 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = shared
            if flags & 0x80:
                own, at = colours(at, flags)
            if at >= len(data):
                break
            bits = data[at]
            stream, at = joined(at + 1)
            if not 2 <= bits <= 8:
                break
            frames.append((Frame(left, top, w, h, stream, own, transparent, disposal, delay), bits, bool(flags & 0x40)))
            transparent, disposal, delay = None, 0, 0
        else:
            break
    return width, height, frames


def render(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height x width x 4) as shown during each frame."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        kept = canvas.copy() if f.disposal == 3 else None
        bottom, right = min(height, f.top + f.height), min(width, f.left + f.width)
        area = canvas[f.top : bottom, f.left : right]
        part = f.indices[: max(0, bottom - f.top), : max(0, right - f.left)]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette), :3] = f.palette
        palette[:, 3] = 255
        shown = palette[part]
        if f.transparent is None:
            area[:] = shown
        else:
            seen = part != f.transparent
            area[seen] = shown[seen]
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = kept


def colour_bins(rgb: np.ndarray) -> np.ndarray:
    """Counts of pixels by their red, then by their green, then by their blue."""
    level = (rgb[..., :3].reshape(-1, 3).astype(np.int64) * BINS >> 8) + np.arange(3) * BINS
    return np.bincount(level.ravel(), minlength=3 * BINS)


def histogram(width: int, height: int, frames: list[Frame]) -> np.ndarray:
    """Colour histogram over all shown frames. Frames that cover the canvas go by their indices, others are composited."""
    total = np.zeros(3 * BINS, np.int64)
    plain = all(f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, width, height) for f in frames)
    if not plain:
        for canvas in render(width, height, frames):
            total += colour_bins(canvas)
        return total
    by_palette: dict[int, list[Frame]] = {}
    for f in frames:
        by_palette.setdefault(id(f.palette), []).append(f)
    for same in by_palette.values():
        counts = np.bincount(np.concatenate([f.indices.ravel() for f in same]), minlength=256)
        palette = np.zeros((256, 3), np.uint8)
        own = same[0].palette
        palette[: len(own)] = own
        level = (palette.astype(np.int64) * BINS >> 8) + np.arange(3) * BINS
        total += np.bincount(level.ravel(), np.repeat(counts, 3), 3 * BINS).astype(np.int64)
    return total


def payload_of(raw: bytes) -> bytes:
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\xff")


def store_texts(texts: list[str]) -> list[tuple[bytes, bytes]]:
    """The UTF-8 bytes of each text and the GIF that holds its payload, a frame for each 576 bytes."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    payloads = [payload_of(r) for r in raws]
    streams = lzw_streams([p[k : k + FRAME] for p in payloads for k in range(0, len(p), FRAME)])
    out, at = [], 0
    for raw, p in zip(raws, payloads, strict=True):
        n = len(p) // FRAME
        out.append((raw, gif_of(streams[at : at + n])))
        at += n
    return out


#: Characters of texts stored together: bounds a worker's memory.
BATCH_CHARS = 4_000_000


def stored_media(docs: DataFrame) -> DataFrame:
    """Store each text as a GIF, read the stored bytes back and describe them; no shuffle."""

    def described(ids: list, texts: list[str]) -> list[tuple]:
        stored = store_texts(texts)
        rows = []
        for doc, (raw, gif), (width, height, frames) in zip(ids, stored, read_gifs([g for _, g in stored]), strict=True):
            back = b"".join([f.indices.tobytes() for f in frames])
            feature = ",".join(map(str, histogram(width, height, frames).tolist()))
            rows.append((
                doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(gif),
                hashlib.sha256(gif).hexdigest(), feature, len(frames), 10 * sum(f.delay for f in frames),
            ))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        names = [part.split()[0] for part in STORED_SCHEMA.split(", ")]
        for batch in batches:
            ids, texts, lo = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            while lo < len(texts):
                hi, chars = lo + 1, len(texts[lo])
                while hi < len(texts) and chars + len(texts[hi]) <= BATCH_CHARS:
                    chars += len(texts[hi])
                    hi += 1
                columns = list(zip(*described(ids[lo:hi], texts[lo:hi]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                lo = hi

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, STORED_SCHEMA)


def frame_table(media: DataFrame, id_column: str, bytes_column: str) -> DataFrame:
    """One row per shown frame of each GIF: pixels, time and histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        names = [part.split()[0] for part in FRAME_SCHEMA.split(", ")]
        for batch in batches:
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, height, frames = read_gif(data or b"")
                for k, canvas in enumerate(render(width, height, frames)):
                    row = (who, k, 10 * frames[k].delay, width, height, frames[k].disposal, canvas.tobytes(), colour_bins(canvas).tolist())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return media.select(media[id_column].cast("long").alias("media_id"), media[bytes_column].alias("data")).mapInArrow(run, FRAME_SCHEMA)
