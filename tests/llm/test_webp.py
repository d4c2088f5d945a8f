import hashlib
import zlib

import numpy as np
import pytest

from plyforge.llm import webp
from plyforge.llm.common import materialize


def picture(rng, height, width, colors=None, alpha=True):
    if colors:
        table = rng.integers(0, 1 << 32, colors)
        return table[rng.integers(0, colors, (height, width))]
    x = np.cumsum(rng.integers(-3, 4, (height, width, 4)), axis=1) % 256
    x = x.astype(np.int64)
    return webp.join(x[..., 3] if alpha else np.full((height, width), 255), x[..., 0], x[..., 1], x[..., 2])


@pytest.mark.parametrize("transforms", [(), ("predictor",), ("cross",), ("green",), ("predictor", "cross", "green"), ("green", "predictor")])
@pytest.mark.parametrize(("cache", "groups"), [(0, 1), (5, 1), (11, 2), (0, 3)])
def test_round_trip(transforms, cache, groups):
    rng = np.random.default_rng(len(transforms) + cache)
    for height, width, alpha in ((13, 9, True), (1, 1, False), (8, 17, False)):
        px = picture(rng, height, width, alpha=alpha)
        assert (webp.decode(webp.encode(px, transforms, cache, groups=groups)) == px).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palettes(colors):
    px = picture(np.random.default_rng(colors), 15, 13, colors)
    for transforms in (("palette",), ("palette", "predictor")):
        assert (webp.decode(webp.encode(px, transforms, 3)) == px).all()


def test_short_distances():
    spots = webp.neighbours()
    assert len(spots) == 120 and spots[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)] and spots[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


def test_payloads_of_all_kinds():
    rng = np.random.default_rng(1)
    cases = [b"", b"a", b"plain text " * 300, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), bytes([255]) * 576, bytes([255]) * 9000, b"x" * 571, b"x" * 575, "äöü€\U0001f600".encode() * 50]
    for raw in cases:
        px = webp.payload(raw)
        media = webp.encode_payload(px)
        assert (webp.decode_payload(media) == px).all() and len(px) % 576 == 0 and len(px) > 0
        assert px.tobytes()[: len(raw)] == raw and set(px.tobytes()[len(raw) :]) <= {255}
        bits = webp.Bits(media[21:])
        assert bits.read(14) == 575


def test_the_smaller_form_is_taken():
    rng = np.random.default_rng(7)
    own = [b"Some plain words, as texts have them. ", bytes(rng.integers(200, 230, 9000, dtype=np.uint8)), b"The line that repeats, again.\n" * 400 + b"x" + b"The line that repeats, again.\n" * 9]
    few = [b"".join(b"%d " % i for i in rng.integers(0, 10**9, 3000)), bytes(rng.integers(97, 99, 9000, dtype=np.uint8))]
    for raw in own + few:
        px = webp.payload(raw)
        media = webp.encode_payload(px)
        assert (webp.decode_payload(media) == px).all()
        bits = webp.Bits(media[21:])
        bits.at = 32
        assert bits.read(1) == (raw in few), raw[:20]
    assert len(webp.encode_payload(webp.payload(b"abcdefgh" * 30_000))) < 800


def test_repeats():
    data = np.frombuffer(b"0123456789abcdefXYZ0123456789abcdef" + b"q" * 40, np.uint8)
    found = webp.repeats(data)
    assert found[0] == (19, 16, 19) and all((data[p : p + n] == data[p - d : p - d + n]).all() for p, n, d in found if n <= d)


def test_streams_written_by_hand():
    """Bits set down from the published format, not by the encoder."""

    def stream(*fields):
        value = at = 0
        for v, n in fields:
            value, at = value | v << at, at + n
        body = b"/" + value.to_bytes(-(-at // 8), "little")
        return b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)

    size = lambda w, h: [(w - 1, 14), (h - 1, 14), (1, 1), (0, 3)]
    one = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]  # a simple code of one symbol of eight bits
    two = lambda a, b: [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]
    # three pixels of green 7, 9, 7 with red 1, blue 2, alpha 255
    data = stream(*size(3, 1), (0, 1), (0, 1), (0, 1), *two(7, 9), *one(1), *one(2), *one(255), *one(0), (0, 1), (1, 1), (0, 1))
    assert webp.decode(data).tolist() == [[0xFF010702, 0xFF010902, 0xFF010702]]
    # the same through subtract-green: stored red and blue are 1 - g, 2 - g, so only greens of one value fit one symbol
    data = stream(*size(2, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *one(4), *one(253), *one(254), *one(255), *one(0))
    assert webp.decode(data).tolist() == [[0xFF010402, 0xFF010402]]
    # a colour cache of one bit: green symbols 5 and 280 + slot; the slot of 0xFF000500 is the top bit of the product
    slot = (0x1E35A7BD * 0xFF000500 & 0xFFFFFFFF) >> 31
    lengths = [0] * 282
    lengths[5] = lengths[280 + slot] = 1
    runs, s = [], 0
    codes = [(0, 1), (1, 4)] + [(n, 3) for n in (2, 2, 0, 0, 2)]  # symbols 17, 18, 0, 1, 2 -> the lengths' own code
    codes = [(0, 1), (0, 4), (2, 3), (2, 3), (2, 3), (2, 3)]  # 17, 18, 0, 1: two bits each; in order 0: 00, 1: 01, 17: 10, 18: 11
    bits_of = {0: (0, 2), 1: (2, 2), 17: (1, 2), 18: (3, 2)}
    while s < 282:
        if lengths[s]:
            runs.append(bits_of[1])
            s += 1
            continue
        n = next((i for i in range(s, 282) if lengths[i]), 282) - s
        if n >= 11:
            n = min(n, 138)
            runs += [bits_of[18], (n - 11, 7)]
        elif n >= 3:
            runs += [bits_of[17], (n - 3, 3)]
        else:
            runs += [bits_of[0]] * n
        s += n
    green = [*codes, (0, 1), *runs]
    data = stream(*size(3, 1), (0, 1), (1, 1), (1, 4), (0, 1), *green, *one(0), *one(0), *one(255), *one(0), (0, 1), (1, 1), (0, 1))
    assert webp.decode(data).tolist() == [[0xFF000500] * 3]


def test_long_payload_is_several_images():
    px = webp.payload(b"ab" * (576 * webp.MOST_ROWS // 2) + b"tail")
    assert (webp.decode_payload(webp.encode_payload(px)) == px).all()


def test_broken_files():
    media = webp.encode_payload(webp.payload(b"some text"))
    for bad in (b"", media[:10], media[:-60], b"RIFX" + media[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_store_and_read(spark):
    rows = [(1, "text", "m"), (2, "text", "m"), (3, None, "m"), (None, "é" * 700, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in webp.read(materialize(webp.store(docs), "media"), with_pixels=True).collect()}
    for doc, text, _ in rows:
        raw, r = (text or "").encode(), got[doc]
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, bytes(r.pixels)) == (len(raw), len(want), want)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
    assert got[1][1:] == got[2][1:]
    assert webp.read(webp.store(docs.limit(0))).count() == 0


def test_left_predictor_where_it_is_smaller():
    rng = np.random.default_rng(8)
    steps = np.cumsum(rng.integers(0, 3, 576 * 7)).astype(np.uint8)  # noise about a ramp
    media = webp.encode_payload(steps)
    assert (webp.decode_payload(media) == steps).all() and len(media) < 0.35 * len(steps)
    bits = webp.Bits(media[21:])
    assert [bits.read(n) for n in (14, 14, 1, 3, 1, 2, 3)] == [575, 6, 0, 0, 1, 0, 7]
    assert (webp.from_left(steps, 576)[1:576] == np.diff(steps[:576])).all()
    for raw in (b"", b"plain text, as most are " * 50, bytes(range(256)) * 40):
        px = webp.payload(raw)
        assert (webp.decode_payload(webp.encode_payload(px)) == px).all()


def test_running_sums_equal_the_predictor_pixel_by_pixel():
    rng = np.random.default_rng(9)
    px = rng.integers(0, 1 << 32, 9 * 7)
    for mode in (1, 2):
        grid = np.full(12, mode << 8)
        rest = webp.predictor(px, 9, 7, grid, 2, -1)
        mixed = np.concatenate([grid, [0]])  # a block that no pixel uses keeps it from the short way
        assert (webp.predictor(rest, 9, 7, grid, 2, 1) == px).all() and (webp.predictor(rest, 9, 7, mixed, 2, 1) == px).all()
