import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from skarn.llm import webp

# A writer of streams that use every feature, made from the format's description, for small images as lists of
# (alpha, red, green, blue).


def whole(pixels):
    return [a << 24 | r << 16 | g << 8 | b for a, r, g, b in pixels]


def put_code(out, counts):
    lengths = webp.code_lengths(np.array(counts))
    webp.write_code(out, lengths)
    codes = webp.canonical(lengths).tolist() if np.count_nonzero(lengths) > 1 else [0] * len(counts)
    sizes = lengths.tolist() if np.count_nonzero(lengths) > 1 else [0] * len(counts)
    return lambda s: out.put(codes[s], sizes[s])


def prefix(value):
    """(symbol, extra bits, how many) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def distance_code(back, width):
    for k, (x, y) in enumerate(webp.NEAR):
        if max(1, x + y * width) == back:
            return k + 1
    return back + len(webp.NEAR)


def tokens_of(pixels, width, cache_bits, copies, rng):
    values, at, cache, out = whole(pixels), 0, {}, []
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(values):
        best = (0, 0)
        if copies:
            for back in range(1, at + 1):
                n = 0
                while at + n < len(values) and n < 4096 and values[at + n] == values[at + n - back]:
                    n += 1
                best = max(best, (n, -back))
        if best[0] >= 3 and rng.random() < 0.9:
            out.append(("copy", best[0], -best[1], at))
            n = best[0]
        elif cache_bits and cache.get(slot(values[at])) == values[at]:
            out.append(("cache", slot(values[at]), 0, at))
            n = 1
        else:
            out.append(("pixel", pixels[at], 0, at))
            n = 1
        if cache_bits:
            for v in values[at : at + n]:
                cache[slot(v)] = v
        at += n
    return out


def put_image(out, pixels, width, rng, cache_bits=0, copies=False, tile=None, main=False):
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, which = 1, lambda at: 0
    if main:
        out.put(1 if tile else 0, 1)
        if tile:
            out.put(tile - 2, 3)
            across, down = -(-width >> tile), -(-(len(pixels) // width) >> tile)
            choice = [rng.randrange(3) for _ in range(across * down)]
            choice[0] = 2
            put_image(out, [(255, 0, c, 0) for c in choice], across, rng)
            groups, which = 3, lambda at: choice[(at // width >> tile) * across + (at % width >> tile)]
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    steps = []
    for kind, x, back, at in tokens_of(pixels, width, cache_bits, copies, rng):
        group = counts[which(at)]
        if kind == "pixel":
            a, r, g, b = x
            step = [(0, g), (1, r), (2, b), (3, a)]
        elif kind == "cache":
            step = [(0, 280 + x)]
        else:
            s, extra, n = prefix(x)
            d, more, m = prefix(distance_code(back, width))
            step = [(0, 256 + s), (None, extra, n), (4, d), (None, more, m)]
        for part in step:
            if part[0] is not None:
                group[part[0]][part[1]] += 1
        steps.append((which(at), step))
    put = [[put_code(out, c) for c in group] for group in counts]
    for group, step in steps:
        for part in step:
            if part[0] is None:
                out.put(part[1], part[2])
            else:
                put[group][part[0]](part[1])


def half(a, b):
    return [(x + y) // 2 for x, y in zip(a, b)]


def clamped(values):
    return [min(255, max(0, v)) for v in values]


def selected(left, top, corner):
    """The neighbour nearer to left + top - corner, by the sum over channels; top where both are as near."""
    guess = [x + t - c for x, t, c in zip(left, top, corner)]
    far = lambda p: sum(abs(g - v) for g, v in zip(guess, p))
    return left if far(left) < far(top) else top


#: The fourteen predictions, written down from the format's description: left, top, top right, top left.
PREDICTIONS = [
    lambda x, t, r, c: (255, 0, 0, 0),
    lambda x, t, r, c: x,
    lambda x, t, r, c: t,
    lambda x, t, r, c: r,
    lambda x, t, r, c: c,
    lambda x, t, r, c: half(half(x, r), t),
    lambda x, t, r, c: half(x, c),
    lambda x, t, r, c: half(x, t),
    lambda x, t, r, c: half(c, t),
    lambda x, t, r, c: half(t, r),
    lambda x, t, r, c: half(half(x, c), half(t, r)),
    lambda x, t, r, c: selected(x, t, c),
    lambda x, t, r, c: clamped(p + q - o for p, q, o in zip(x, t, c)),
    lambda x, t, r, c: clamped(h + (abs(h - o) // 2) * (1 if h >= o else -1) for h, o in zip(half(x, t), c)),
]


def forward_predictor(pixels, width, tile, modes):
    across, out = -(-width >> tile), []
    for at, pixel in enumerate(pixels):
        y, x = divmod(at, width)
        if not y:
            guess = pixels[at - 1] if x else (255, 0, 0, 0)
        elif not x:
            guess = pixels[at - width]
        else:
            guess = PREDICTIONS[modes[(y >> tile) * across + (x >> tile)]](pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
        out.append(tuple((p - q) % 256 for p, q in zip(pixel, guess)))
    return out


def signed(x):
    return x - 256 if x > 127 else x


def forward_cross(pixels, width, tile, factors):
    across, out = -(-width >> tile), []
    for at, (a, r, g, b) in enumerate(pixels):
        y, x = divmod(at, width)
        _, red_to_blue, green_to_blue, green_to_red = factors[(y >> tile) * across + (x >> tile)]
        d = lambda t, c: (signed(t) * signed(c)) >> 5
        out.append((a, (r - d(green_to_red, g)) % 256, g, (b - d(green_to_blue, g) - d(red_to_blue, r)) % 256))
    return out


def stream(pixels, width, rng, transforms=(), **how):
    out, height = webp.Writer(), len(pixels) // width
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        tile = 2
        tiles = -(-width >> tile) * -(-height >> tile)
        if kind == webp.PREDICTOR:
            out.put(tile - 2, 3)
            modes = [rng.randrange(14) for _ in range(tiles)]
            put_image(out, [(255, 0, m, 0) for m in modes], -(-width >> tile), rng)
            pixels = forward_predictor(pixels, width, tile, modes)
        elif kind == webp.CROSS_COLOUR:
            out.put(tile - 2, 3)
            factors = [(255, *(rng.randrange(256) for _ in range(3))) for _ in range(tiles)]
            put_image(out, factors, -(-width >> tile), rng)
            pixels = forward_cross(pixels, width, tile, factors)
        elif kind == webp.SUBTRACT_GREEN:
            pixels = [(a, (r - g) % 256, g, (b - g) % 256) for a, r, g, b in pixels]
        else:
            colours = sorted(set(pixels))
            out.put(len(colours) - 1, 8)
            put_image(out, [tuple((c - p) % 256 for c, p in zip(x, y)) for x, y in zip(colours, [(0, 0, 0, 0), *colours])], len(colours), rng)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            each, index = 8 >> packed, [colours.index(p) for p in pixels]
            pixels = []
            for y in range(height):
                row = index[y * width : (y + 1) * width]
                pixels += [(255, 0, sum(v << each * k for k, v in enumerate(row[x : x + (1 << packed)])), 0) for x in range(0, width, 1 << packed)]
            width = -(-width >> packed)
    out.put(0, 1)
    put_image(out, pixels, width, rng, main=True, **how)
    return out.value.to_bytes((out.size + 7) // 8, "little")


def test_near_distances_are_those_of_the_format():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.NEAR[34:41] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5)]
    assert webp.NEAR[-4:] == [(8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)][1:]


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0), (0, 1, 2), (3, 0)])
def test_decoder_inverts_every_feature(colours, transforms):
    rng = random.Random(f"{colours} {transforms}")
    choice = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(colours)]
    for how in ({}, {"cache_bits": 3}, {"copies": True}, {"tile": 2}, {"cache_bits": 6, "copies": True, "tile": 3}):
        width, height = rng.randint(1, 23), rng.randint(1, 19)
        pixels = [rng.choice(choice) for _ in range(width * height)]
        for at in range(len(pixels)):
            if at >= 7 and rng.random() < 0.6:
                pixels[at] = pixels[at - rng.choice([1, 7, min(at, width)])]
        found = webp.decode_stream(stream(pixels, width, rng, transforms, **how))
        assert found.shape == (height, width)
        assert found.reshape(-1).tolist() == whole(pixels), how


def test_a_file_of_another_writer():
    # The lossless sample that web pages use to find out whether a browser knows the format: one transparent pixel.
    found = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert [i.tolist() for i in found] == [[[0]]]


@pytest.mark.parametrize("seed", range(30))
def test_green_images_take_the_same_values_either_way(seed, monkeypatch):
    rng = random.Random(seed)
    width, height = rng.randint(1, 40), rng.randint(1, 40)
    pixels = [(255, 0, rng.choice([0, 7, 7, 7, 200, *range(rng.choice([1, 30, 256]))]), 0) for _ in range(width * height)]
    for at in range(9, len(pixels)):
        if rng.random() < 0.7:
            pixels[at] = pixels[at - rng.choice([1, 2, 9])]
    made = stream(pixels, width, rng, copies=True)
    assert webp.decode_stream(made).reshape(-1).tolist() == whole(pixels)
    monkeypatch.setattr(webp, "_greens", lambda bits, green, distance, width, total: webp._pixels(bits, width, total, 0, [[green, *[webp.single(0)] * 3, distance]], 0, None) >> 8)
    assert webp.decode_stream(made).reshape(-1).tolist() == whole(pixels)


def test_prefixes_are_the_inverse_of_amounts():
    values = np.array([*range(1, 5000), *(2**k + d for k in range(12, 21) for d in (-1, 0, 1, 2))])
    for value, symbol, extra, n in zip(values.tolist(), *(x.tolist() for x in webp.prefixed(values))):
        assert (symbol, extra, n) == prefix(value)


def test_repeats_become_back_references_and_few_samples_a_palette():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    passage = " ".join(words[:40])
    text = " ".join([*words, passage, "between", passage, *words[500:900]]).encode()
    data = webp.payload(text)
    found = webp.matches(np.frombuffer(data, dtype=np.uint8))
    assert found[:, 1].sum() > 2 * len(passage) - 40 and (found[:, 1] >= webp.MIN_MATCH).all() and (found[:, 1] <= 4096).all()
    assert (np.diff(found[:, 0]) >= found[:-1, 1]).all()
    for at, length, back in found.tolist():
        assert all(data[at + k] == data[at + k - back] for k in range(length))
    for body in (text, b"the " * 50_000, b"0123456789abcdef" * 900, b"ab" * 7000, b"", b"abc " * 99, (passage * 300).encode(), b"\n \n" * 5000 + text):
        data = webp.payload(body)
        media = webp.encode(data)
        assert b"".join((i >> 8 & 255).astype(np.uint8).tobytes() for i in webp.decode(media)) == data
        assert all((i & 0xFFFF00FF == 0xFF000000).all() for i in webp.decode(media))
    assert len(webp.encode(webp.payload(b"the " * 50_000))) < 40_000 and len(webp.encode(webp.payload((passage * 300).encode()))) < 12_000
    assert len(webp.encode(webp.payload(b"ab" * 7000))) < 14_000 / 8 + 100


def test_payloads_round_trip():
    rng = random.Random(7)
    skewed = bytes(b for k in range(24) for b in [k] * min(1 << k, 1 << 16))  # codes longer than 15 bits without the limit
    for text in (b"", b"a", b"abc" * 21 + b"d", bytes(range(256)) * 3, rng.randbytes(5000), skewed, b"x" * 64, "é" .encode() * 999):
        data = webp.payload(text)
        assert len(data) % 64 == 0 and len(data) >= 64 and data.startswith(text)
        images = webp.decode(webp.encode(data))
        assert b"".join((i >> 8 & 255).astype(np.uint8).tobytes() for i in images) == data
        assert all((i & 0xFFFF00FF == 0xFF000000).all() for i in images)


def test_long_payloads_take_several_frames(monkeypatch):
    monkeypatch.setattr(webp, "FRAME", 128)
    data = webp.payload(random.Random(8).randbytes(1000))
    images = webp.decode(webp.encode(data))
    assert len(images) == 8 and b"".join((i >> 8).astype(np.uint8).tobytes() for i in images) == data


def test_broken_media_raise():
    good = webp.encode(webp.payload(b"some text that is long enough" * 9))
    for bad in (b"RIFF", good[:-40] , b"x" + good[1:], good[:20] + b"\x30" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_columns(spark):
    texts = [None, "", "a", "word " * 40, "é" * 77, "x" * 300_000, "word " * 40]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes long")
    pixels = webp.read(webp.store(docs))
    images = {r.doc_id: r.images for r in pixels.collect()}
    out = webp.features(pixels).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        r, body = by[i if i != 2 else None], (t or "").encode()
        data = body + bytes(-len(body) % 64 if body else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        own = images[r.doc_id]
        assert sum(im.height * im.width for im in own) == len(data)
        assert b"".join(bytes(im.argb) for im in own) == b"".join(bytes([0, b, 0, 255]) for b in data)
    assert by[3].media_sha256 == by[6].media_sha256 and by[3].feature == by[6].feature
    assert webp.features(webp.read(webp.store(docs.limit(0)))).count() == 0
