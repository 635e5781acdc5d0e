"""Lossless WebP: every feature of the format through both decoders, and the media operator."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import media, webp

RNG = np.random.default_rng(1)
NOISE = RNG.integers(0, 2**32, (13, 17), dtype=np.uint32)
FEW = RNG.integers(0, 4, (20, 33), dtype=np.uint32) * np.uint32(0x01020304)


def round_trip(pixels, **how):
    data = webp.encode(pixels, **how)
    for fast in (True, False):
        assert (webp.decode(data, fast) == pixels).all()
    return data


@pytest.mark.parametrize("how", [{}, {"copies": True}, {"cache_bits": 5}, {"copies": True, "cache_bits": 3}, {"palette": True, "copies": True}, {"subtract_green": True}])
def test_prefix_codes_references_cache_palette(how):
    round_trip(FEW, **how)
    if "palette" not in how:
        round_trip(NOISE, **how)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_bundled_palettes(colours):
    round_trip(RNG.choice(RNG.integers(0, 2**32, colours, dtype=np.uint32), (9, 21)), palette=True)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    round_trip(NOISE, modes=np.full((4, 5), mode))


def test_all_transforms_together():
    tiles = RNG.integers(0, 2**32, (4, 5), dtype=np.uint32)
    round_trip(NOISE, modes=RNG.integers(0, 14, (4, 5)), cross=tiles, subtract_green=True, copies=True, cache_bits=4)
    round_trip(np.full((3, 3), 7, np.uint32))
    round_trip(np.array([[5]], np.uint32))


def test_meta_prefix_groups():
    """Two prefix groups by tile, written by hand: green differs left and right."""
    w = webp._start(8, 4)
    w.put(0, 1), w.put(0, 1), w.put(1, 1), w.put(0, 3)  # no transform, no cache, groups in tiles of 4
    webp._put_tokens(w, [("pixel", 0xFF000000), ("pixel", 0xFF000100)], False)
    for green in (10, 200):
        for counts, size in (({green: 1}, 280), ({0: 1}, 256), ({0: 1}, 256), ({255: 1}, 256), ({}, 40)):
            webp.put_code(w, counts, size)
    found = webp.decode(webp.container(webp.pack(*w.arrays())))
    assert (found[:, :4] == 0xFF000A00).all() and (found[:, 4:] == 0xFF00C800).all()


#: Fixed value: the one-pixel lossless image that web pages commonly test a browser's support with; made by another encoder.
ONE_PIXEL = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="


def test_an_image_of_another_encoder():
    for fast in (True, False):
        assert webp.decode(base64.b64decode(ONE_PIXEL), fast).tolist() == [[0]]


def plain_feature(p):
    mean = sum(p) // len(p)
    var = sum(x * x for x in p) // len(p) - mean * mean
    change = sum(abs(a - b) for a, b in zip(p, p[1:])) // len(p)
    bins = [sum(x // 32 == k for x in p) * 1000 // len(p) for k in range(8)]
    return f"64x{len(p) // 64} mean={mean} var={var} change={change} hist={','.join(map(str, bins))}"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_features_against_plain_code(data):
    payload = media.padded(data)
    assert media.features(payload) == plain_feature(payload)


def test_damage_is_noticed():
    data = round_trip(NOISE)
    for broken in (b"RIFF", data[:40], data[:20] + b"\0" + data[21:]):
        with pytest.raises(webp.CorruptImage):
            webp.decode(broken)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_any_bytes_survive(data, repeats):
    payload = media.padded((data + b"\n") * repeats)
    stored = media.store(payload)
    assert media.read(stored) == payload
    assert b"".join(((webp.decode(stored, fast=False) >> 8) & 255).astype(np.uint8).tobytes() for _ in (0,)) == payload


def test_operator_on_odd_texts(docs, oddities, clashing):
    rows = media.described(media.to_media(clashing(docs(oddities)))).collect()
    assert len(rows) == len(oddities)
    expected = {i: media.padded((t or "").encode()) for i, t, _ in oddities}
    for r in rows:
        p = expected[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (3, 40)}) == 1
    assert media.described(media.to_media(docs([]))).count() == 0


def test_pixel_arrays(docs):
    long = "abc\n" * 60_000
    rows = media.pixels(media.to_media(docs([(1, long, None), (2, "", None)]))).orderBy("doc_id", "frame").collect()
    green = b"".join(((np.frombuffer(r.argb, "<u4") >> 8) & 255).astype(np.uint8).tobytes() for r in rows if r.doc_id == 1)
    assert green == media.padded(long.encode()) and [r.frame for r in rows] == [0, 1, 0]
    assert all(len(r.argb) == 4 * r.width * r.height for r in rows)
