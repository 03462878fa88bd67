import hashlib
import random
import struct
import zlib

import numpy as np

from quillspark.llm import media_gif as g


def test_payloads_round_trip(edge, empty, docs):
    for df in (edge, docs):
        rows = g.stored_media(df).collect()
        assert len(rows) == df.count()
        texts = {(r["doc_id"], (r["text"] or "")) for r in df.collect()}
        want = {(d, hashlib.sha256(g.payload_of(t.encode())).hexdigest(), len(t.encode()), zlib.crc32(g.payload_of(t.encode())[-32:])) for d, t in texts}
        assert {(r["doc_id"], r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in rows} == want
        assert all(r["payload_bytes"] == 576 * r["n_frames"] and sum(map(int, r["feature"].split(","))) == 3 * r["payload_bytes"] for r in rows)
    assert g.stored_media(empty).count() == 0


def test_lzw_paths_agree():
    draw = random.Random(1)
    frames = [bytes(draw.choice(b"abcd" if k % 2 else bytes(range(256))) for _ in range(576)) for k in range(40)]
    assert g.lzw_streams(frames) == [g._stream(g.lzw_codes(f), 8) for f in frames]
    for f, s in zip(frames, g.lzw_streams(frames), strict=True):
        assert g.lzw_decode(s, 8, 576) == f
    big = bytes(draw.randrange(256) for _ in range(60000)) + b"aaaa" * 5000  # the code table fills and is cleared
    assert g.read_gif(g.encode_gif([big], 400, 200))[2][0].indices.tobytes() == big
    small = bytes(draw.randrange(4) for _ in range(3000))
    assert g.lzw_decode(g._stream(g.lzw_codes(small, 2), 2), 2, 3000) == small
    assert g.decode_streams([(g.lzw_streams([f])[0][:40], 8, 576) for f in frames[:6]])[0][:10] == frames[0][:10]


def gif(parts, width=4, height=2, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + bytes(c for rgb in colours for c in rgb)
    for pixels, box, disposal, transparent, delay, interlaced, own in parts:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<H", delay) + bytes([transparent or 0, 0])
        out += b"\x2c" + struct.pack("<HHHH", *box) + bytes([0x40 * interlaced | (0x81 if own else 0)]) + (bytes(c for rgb in own for c in rgb) if own else b"")
        out += b"\x02" + g._blocks(g._stream(g.lzw_codes(bytes(pixels), 2), 2))
    return out + b"\x21\xfe\x03abc\x00\x3b"


def test_disposal_transparency_palettes_and_interlace():
    whole, box = (0, 0, 4, 2), (1, 0, 2, 1)
    purple = ((9, 9, 9), (200, 0, 200), (1, 1, 1), (2, 2, 2))
    data = gif([([1] * 8, whole, 1, None, 5, False, None), ([2, 0], box, 2, 0, 6, False, None), ([3, 3], (0, 1, 2, 1), 3, None, 7, False, None), ([1, 1], box, 0, None, 8, False, purple)])
    width, height, frames = g.read_gif(data)
    shown = [c[..., :3].tolist() for c in g.render(width, height, frames)]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert shown[0] == [[red] * 4] * 2
    assert shown[1] == [[red, green, red, red], [red] * 4]  # index 0 is transparent
    assert shown[2][0] == [red, [0] * 3, [0] * 3, red] and shown[2][1][:2] == [blue, blue]  # the box was cleared
    assert shown[3][1] == [red] * 4 and shown[3][0][1:3] == [[200, 0, 200]] * 2  # the blue went back
    assert [f.delay for f in frames] == [5, 6, 7, 8]
    rows = [[k % 4] * 4 for k in range(16)]
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    woven = gif([([p for k in order for p in rows[k]], (0, 0, 4, 16), 0, None, 0, True, None)], 4, 16)
    assert g.read_gif(woven)[2][0].indices.tolist() == rows


def test_damaged_gifs(spark):
    data = gif([([1] * 8, (0, 0, 4, 2), 0, None, 5, False, None)])
    for k in range(len(data)):
        g.read_gif(data[:k])
    assert g.read_gif(b"not a gif") == (0, 0, [])
    rows = g.frame_table(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"x"))], "id long, gif binary"), "id", "gif").collect()
    assert len(rows) == 1 and rows[0]["delay_ms"] == 50 and sum(rows[0]["histogram"]) == 24 and np.frombuffer(rows[0]["rgba"], np.uint8).reshape(2, 4, 4)[0, 0].tolist() == [255, 0, 0, 255]


def plain_gif(data):
    """Pixels (rgb) of all frames of a full-canvas GIF with one palette, one code at a time."""
    flags, at = data[10], 13
    size = 2 << (flags & 7)
    palette, at, frames = [tuple(data[at + 3 * k : at + 3 * k + 3]) for k in range(size)], at + 3 * size, []
    while data[at] != 0x3B:
        is_image, body = data[at] == 0x2C, b""
        at += 11 if is_image else 2
        bits = data[at - 1]
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if not is_image:
            continue
        stream, held, place, out = 0, 0, 0, []
        clear, width, table, last = 1 << bits, bits + 1, {}, None
        while True:
            while held < width:
                stream |= body[place] << held
                place, held = place + 1, held + 8
            code, stream, held = stream & (1 << width) - 1, stream >> width, held - width
            if code == clear:
                width, table, last = bits + 1, {k: bytes([k]) for k in range(clear)}, None
                continue
            if code == clear + 1:
                break
            entry = table[code] if code in table else last + last[:1]
            out.append(entry)
            if last is not None and len(table) + 2 < 4096:
                table[len(table) + 2] = last + entry[:1]
                if len(table) + 2 == 1 << width and width < 12:
                    width += 1
            last = entry
        frames.append([palette[p] for p in b"".join(out)])
    return frames


def test_features_against_a_plain_decoder(spark):
    texts = ["", "plain words " * 80, "Ünïcödé 中文 😀 " * 30, "".join(chr(32 + k * 7 % 90) for k in range(3000))]
    rows = {r["doc_id"]: r for r in g.stored_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        gif = g.store_texts([text])[0][1]
        assert rows[k]["media_sha256"] == hashlib.sha256(gif).hexdigest() and rows[k]["media_bytes"] == len(gif)
        frames, bins = plain_gif(gif), [0] * (3 * g.BINS)
        for pixel in (p for f in frames for p in f):
            for channel in range(3):
                bins[channel * g.BINS + pixel[channel] * g.BINS // 256] += 1
        assert rows[k]["feature"] == ",".join(map(str, bins)) and rows[k]["n_frames"] == len(frames)
        payload = g.payload_of(text.encode())
        assert [p[0] for f in frames for p in f] == list(payload)  # the palette is the grey ramp


def test_pipeline_against_plain_python(spark, sf):
    """Each stage on its predecessor's rows, against sets and dictionaries."""
    import corpus_pipeline as p
    from test_dedup_and_join import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    stage = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["quality classifier", "exact dedup", "n-gram join", "mixing", "packing"]
    good = stage["quality classifier"](spark, docs, sf)
    assert good.columns == names
    good_rows = {r["doc_id"]: r["text"] for r in good.collect()}
    last: dict = {}
    for d, t in good_rows.items():
        last[t] = max(d, last.get(t, d))
    unique = spark.createDataFrame(stage["exact dedup"](spark, good, sf).collect(), good.schema)
    assert unique.columns == names and {r["doc_id"] for r in unique.collect()} == set(last.values())
    near = spark.createDataFrame(stage["n-gram join"](spark, unique, sf).collect(), good.schema)
    want = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in unique.collect()], 5, 80) if d == c}
    assert {r["doc_id"] for r in near.collect()} == want
    mixed = spark.createDataFrame(stage["mixing"](spark, near, sf).collect(), good.schema)
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} == want
    packed = stage["packing"](spark, mixed, sf).collect()
    assert {r["doc_id"] for r in packed} == want
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in p.run(spark, sf).collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_pipeline_stages_on_edges(spark, sf, edge, empty, tmp_path):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, edge, sf)
        rows = out.collect()
        if name == "packing":
            assert len(rows) >= edge.count() and sum(r["length"] for r in rows if r["doc_id"] in (3, 4, 5)) == 3
        else:
            assert out.columns == edge.columns and {r["doc_id"] for r in rows} <= {None, *range(1, 12)}, name
            kept = {"exact dedup": {2, 5, 7, 8, 9, 10, 11}, "n-gram join": {None, 1, 3, 4, 5, 6, 8, 9, 10, 11}, "mixing": {None, *range(1, 12)}}.get(name)
            assert kept is None or {r["doc_id"] for r in rows} == kept, name
    for name, docs in (("edge", edge), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert p.run(spark, f"{tmp_path}/empty").count() == 0
    assert {r["doc_id"] for r in p.run(spark, f"{tmp_path}/edge").collect()} <= {None, *range(1, 12)}


def test_frames_of_one_lightness_differ_by_colour():
    red, grey = np.full((4, 4, 3), (255, 0, 0), np.uint8), np.full((4, 4, 3), 76, np.uint8)
    assert g.colour_bins(red).tolist() != g.colour_bins(grey).tolist() and g.colour_bins(red)[[15, 16, 32]].tolist() == [16, 16, 16]
