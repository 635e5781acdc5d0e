"""Lossless WebP (VP8L) pixels: an encoder and a decoder over NumPy.

The decoder reads every feature of the format: simple and normal prefix codes, meta prefix groups, literal
pixels, back-references with the 2-D distance codes, the colour cache, and the predictor, cross-colour,
subtract-green and palette (colour indexing, with bundled pixels) transforms. Pixels are uint32 ARGB.

With one prefix group, tokens are located without a loop over pixels: the codes that start at every bit
position are looked up at once, each position points to the next token's, and the chain from the first is
followed by pointer doubling. Only back-references and cached colours are then resolved in order.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

MAX_BITS = 15
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (dx, dy) of the distance codes 1 to 120, nearest first, as the format lists them.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class CorruptImage(ValueError):
    """The bytes are no VP8L image, or end too early."""


# ---- bits and prefix codes -------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 6], "little") >> (p & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.lengths: list[int] = []

    def put(self, value: int, n: int) -> None:
        """Up to 24 bits."""
        self.values.append(value)
        self.lengths.append(n)

    def arrays(self) -> tuple[list[int], list[int]]:
        return self.values, self.lengths


def pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of at most 24 bits, least significant bit first, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = ends - lengths
    v = np.asarray(values, np.uint32) << (at & 7).astype(np.uint32)
    first = at >> 3
    size = (total + 7) // 8 + 4
    out = np.bincount(first, v & 0xFF, size)
    for k in range(1, 4):
        part = (v >> np.uint32(8 * k)) & 0xFF
        if part.any():
            out += np.bincount(first + k, part, size)
    return out.astype(np.uint8)[: (total + 7) // 8].tobytes()


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Huffman code lengths of the symbols, at most `limit`; a lone symbol has length 0."""
    if len(counts) <= 1:
        return dict.fromkeys(counts, 0)
    while True:
        order = sorted(counts, key=counts.__getitem__)
        n = len(order)
        weights = [counts[x] for x in order]  # leaves, then inner nodes, both in rising order
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= new or weights[leaf] <= weights[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k] = new
                total += weights[k]
            weights.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= limit:
            return dict(zip(order, depth))
        counts = {x: (c + 1) // 2 if c > 1 else 1 for x, c in counts.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        if n == 0:
            return {s: (0, 0)}
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def put_code(w: Writer, counts: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Write a prefix code for the counted symbols; returns it."""
    used = sorted(counts)
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = int(used[0] > 1)
        w.put(wide, 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    if len(used) == 1:  # a lone symbol that the simple form can't name
        lengths = {used[0]: 1}
    else:
        lengths = code_lengths(counts)
    tokens: list[tuple[int, int, int]] = []  # (code, extra value, extra bits)
    at = 0
    for s in used:
        gap = s - at
        while gap:
            if gap < 3:
                tokens += [(0, 0, 0)] * gap
                gap = 0
            elif gap < 11:
                tokens.append((17, gap - 3, 3))
                gap = 0
            else:
                n = min(gap, 138)
                tokens.append((18, n - 11, 7))
                gap -= n
        tokens.append((lengths[s], 0, 0))
        at = s + 1
    counted: dict[int, int] = {}
    for t in tokens:
        counted[t[0]] = counted.get(t[0], 0) + 1
    if len(counted) == 1:
        counted[0 if 0 not in counted else 1] = 1
    meta = code_lengths(counted, 7)
    order = [meta.get(s, 0) for s in LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    w.put(0, 1)
    w.put(n - 4, 4)
    for x in order[:n]:
        w.put(x, 3)
    codes = canonical(meta)
    if len(tokens) < alphabet and len(tokens) >= 2:
        w.put(1, 1)
        bits = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
        w.put((bits - 2) // 2, 3)
        w.put(len(tokens) - 2, bits)
    else:
        w.put(0, 1)
    for s, extra, k in tokens:
        w.put(*codes[s])
        if k:
            w.put(extra, k)
    return {s: (0, 0) for s in used} if len(used) == 1 else canonical(lengths)


@lru_cache(maxsize=None)
def _reversed(bits: int) -> np.ndarray:
    """The numbers below 2**bits, each with its bits in reverse order."""
    x = np.arange(1 << bits, dtype=np.int32)
    return sum(((x >> k) & 1) << (bits - 1 - k) for k in range(bits)) if bits else x


def _table(lengths: dict[int, int] | int, bits: int) -> tuple[np.ndarray, np.ndarray] | int:
    """(symbol, length) for each window of `bits` bits."""
    if isinstance(lengths, int):
        return lengths
    items = sorted((n, s) for s, n in lengths.items())
    sizes = np.array([n for n, _ in items], np.uint8)
    spans = 1 << (bits - sizes.astype(np.int32))
    if spans.sum() != 1 << bits:
        raise CorruptImage("a prefix code is not complete")
    order = _reversed(bits)  # codes are consecutive with the first bit highest; windows have it lowest
    at = np.repeat(np.arange(len(items), dtype=np.uint16), spans)[order]
    return np.array([s for _, s in items], np.uint16)[at], sizes[at]


def read_code(r: Reader, alphabet: int) -> dict[int, int] | int:
    """The code length of each symbol of a prefix code, or its only symbol."""
    if r.read(1):
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        if not two:
            return first
        second = r.read(8)
        return {first: 1, second: 1} if first != second else first
    n = 4 + r.read(4)
    meta = [0] * 19
    for s in LENGTH_ORDER[:n]:
        meta[s] = r.read(3)
    left = alphabet
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
    windows: list[tuple[int, int] | None] = [None] * 128
    used = {s: k for s, k in enumerate(meta) if k}
    for s, (c, k) in (canonical(used) if len(used) > 1 else dict.fromkeys(used, (0, 0))).items():
        for w in range(c, 128, 1 << k):
            windows[w] = (s, k)
    lengths: list[int] = []
    before = 8
    read = r.read
    while len(lengths) < alphabet and left > 0:
        left -= 1
        hit = windows[read(7)]
        if hit is None:
            raise CorruptImage("no such code length")
        s = hit[0]
        r.at += hit[1] - 7
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + r.read(2))
        else:
            lengths += [0] * (3 + r.read(3) if s == 17 else 11 + r.read(7))
    if len(lengths) > alphabet:
        raise CorruptImage("too many code lengths")
    found = {s: k for s, k in enumerate(lengths) if k}
    return found if len(found) > 1 else next(iter(found), 0)


# ---- entropy-coded images -------------------------------------------------------------------------------


def _cached(colour: int, bits: int) -> int:
    return ((CACHE_HASH * colour) & 0xFFFFFFFF) >> (32 - bits)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    k = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << k) + r.read(k) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_pixels(r: Reader, width: int, height: int, top: bool, fast: bool = True) -> np.ndarray:
    """An entropy-coded image of width * height pixels; meta prefix groups only in the top image."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise CorruptImage("colour cache too large")
    groups, of = 1, None
    if top and r.read(1):
        bits = r.read(3) + 2
        w = (width + (1 << bits) - 1) >> bits
        meta = (read_pixels(r, w, (height + (1 << bits) - 1) >> bits, False) >> 8) & 0xFFFF
        of = (bits, w, meta)
        groups = int(meta.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(r, n) for n in (280 + cache, 256, 256, 256, 40)] for _ in range(groups)]
    bits = max((n for g in codes for c in g if not isinstance(c, int) for n in c.values()), default=0)
    codes = [[_table(c, bits) for c in g] for g in codes]
    if fast and groups == 1:
        return _fast(r, width, width * height, codes[0], cache_bits, bits)
    return _slow(r, width, width * height, codes, of, cache_bits, bits)


def _slow(r: Reader, width: int, n: int, groups, of, cache_bits: int, bits: int) -> np.ndarray:
    """One pixel after another; for several prefix groups, and as the plain reading of the format."""
    out = [0] * n
    cache = [0] * (1 << cache_bits)

    def symbol(code) -> int:
        if isinstance(code, int):
            return code
        w, p = r.read(bits), r.at - bits
        r.at = p + int(code[1][w])
        return int(code[0][w])

    i = 0
    while i < n:
        if r.at > 8 * len(r.data):
            raise CorruptImage("pixels end early")
        codes = groups[0] if of is None else groups[int(of[2][((i // width) >> of[0]) * of[1] + ((i % width) >> of[0])])]
        s = symbol(codes[0])
        if s < 256:
            red, blue, alpha = symbol(codes[1]), symbol(codes[2]), symbol(codes[3])
            run = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _value(r, s - 256)
            back = _distance(_value(r, symbol(codes[4])), width)
            if back > i or i + length > n:
                raise CorruptImage("a back-reference leaves the image")
            run = out[i - back : min(i, i - back + length)]
            run = (run * (length // len(run) + 1))[:length]
        else:
            run = [cache[s - 280]]
        out[i : i + len(run)] = run
        i += len(run)
        if cache_bits:
            for c in run:
                cache[_cached(c, cache_bits)] = c
    return np.array(out, np.uint32)


def _fast(r: Reader, width: int, n: int, codes, cache_bits: int, width_bits: int) -> np.ndarray:
    green, *rest = codes
    fixed = [c if isinstance(c, int) else None for c in rest[:3]]
    if isinstance(green, int):
        if green < 256 and None not in fixed:
            return np.full(n, fixed[2] << 24 | fixed[0] << 16 | green << 8 | fixed[1], np.uint32)
        return _slow(r, width, n, [codes], None, cache_bits, width_bits)
    start = r.at >> 3
    limit = min(len(r.data), start + 8 * n + 64)  # a pixel takes 60 bits at most, a reference fewer a pixel
    b = np.frombuffer(r.data[start:limit] + b"\0" * 16, np.uint8).astype(np.uint32)
    n_bytes = len(b) - 8
    words = b[:n_bytes] | b[1 : n_bytes + 1] << 8 | b[2 : n_bytes + 2] << 16
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << width_bits) - 1)).reshape(-1)
    size = len(window)
    step = green[1][window].astype(np.int32)
    has_more = int(green[0].max()) >= 256
    symbols = green[0][window] if has_more else None
    nxt = np.arange(size, dtype=np.int32)
    nxt += step
    literal = None if not has_more else symbols < 256
    for c in rest[:3]:
        if not isinstance(c, int):
            at = np.minimum(nxt, size - 1)
            more = c[1][window[at]]
            nxt += more if literal is None else np.where(literal, more, 0)
    if has_more:
        at = np.flatnonzero((symbols >= 256) & (symbols < 280))
        if len(at):
            p = nxt[at].astype(np.int64)
            prefix = symbols[at].astype(np.int64) - 256
            p += np.where(prefix < 4, 0, (prefix - 2) >> 1)
            p = np.minimum(p, size - 1)
            if isinstance(rest[3], int):
                prefix = np.full(len(at), rest[3])
            else:
                prefix = rest[3][0][window[p]].astype(np.int64)
                p += rest[3][1][window[p]]
            p += np.where(prefix < 4, 0, (prefix - 2) >> 1)
            nxt[at] = np.minimum(p, size - 1)
    np.minimum(nxt, size - 1, out=nxt)
    # Positions of the tokens: 16 at a time by doubled pointers, then the 16 within each stride at once.
    jump = nxt
    for _ in range(4):
        jump = jump[jump]
    anchors, p, count = [], r.at & 7, n // 16 + 1
    at_jump = jump.item
    for _ in range(count):
        anchors.append(p)
        p = at_jump(p)
        if p >= size - 1:
            break
    cur = np.array(anchors, np.int32)
    found = np.empty((len(cur), 16), np.int32)
    for i in range(16):
        found[:, i] = cur
        cur = nxt[cur]
    found = found.reshape(-1)
    if literal is None:
        if len(found) < n or int(nxt[found[n - 1]]) > 8 * (len(r.data) - start):
            raise CorruptImage("pixels end early")
        found = found[:n]
        pixels = _literals(found, window, green, rest, size)
        r.at = 8 * start + int(nxt[found[-1]])
        return pixels
    kind = symbols[found]
    plain = kind < 256
    pixels = _literals(found, window, green, rest, size)
    back = np.flatnonzero((kind >= 256) & (kind < 280))
    lengths = np.ones(len(found), np.int64)
    bits = Reader(r.data)
    refs = {}
    base = 8 * start
    covered = np.cumsum(lengths)
    for k in back.tolist():
        q = int(found[k])
        bits.at = base + q + int(step[q])
        length = _value(bits, int(kind[k]) - 256)
        if isinstance(rest[3], int):
            prefix = rest[3]
        else:
            q = bits.at - base
            if q >= size:
                break
            prefix = int(rest[3][0][window[q]])
            bits.at += int(rest[3][1][window[q]])
        refs[k] = (length, _distance(_value(bits, prefix), width))
        lengths[k] = length
        if k % 4096 == 0 and int(lengths[: k + 1].sum()) > n + 8192:
            break  # the rest lies beyond the image
    covered = np.cumsum(lengths)
    m = int(np.searchsorted(covered, n, side="left")) + 1
    if m > len(found) or covered[m - 1] != n or int(nxt[found[m - 1]]) > 8 * (len(r.data) - start):
        raise CorruptImage("pixels end early" if m > len(found) else "a back-reference leaves the image")
    r.at = base + int(nxt[found[m - 1]])
    places = covered[:m] - lengths[:m]
    out = np.zeros(n, np.uint32)
    if (kind[:m] >= 280).any():
        return _with_cache(out, places.tolist(), kind[:m].tolist(), pixels[:m].tolist(), refs, cache_bits)
    out[places[plain[:m]]] = pixels[:m][plain[:m]]
    for k, (length, away) in refs.items():
        if k < m:
            _copy(out, int(places[k]), length, away)
    return out


def _literals(found, window, green, rest, size) -> np.ndarray:
    """ARGB of the tokens at the found positions, read as literals."""
    p = found
    g = green[0][window[p]].astype(np.uint32)
    out = (g & 0xFF) << np.uint32(8)
    p = p + green[1][window[p]]
    for c, shift in zip(rest[:3], (16, 0, 24)):
        if isinstance(c, int):
            out |= np.uint32(c << shift)
        else:
            w = window[np.minimum(p, size - 1)]
            out |= c[0][w].astype(np.uint32) << np.uint32(shift)
            p = p + c[1][w]
    return out


def _copy(out: np.ndarray, i: int, length: int, away: int) -> None:
    if away > i:
        raise CorruptImage("a back-reference leaves the image")
    if away >= length:
        out[i : i + length] = out[i - away : i - away + length]
    else:
        out[i : i + length] = np.resize(out[i - away : i], length)


def _with_cache(out, places, kinds, pixels, refs, cache_bits) -> np.ndarray:
    cache = [0] * (1 << cache_bits)
    for k, (i, kind) in enumerate(zip(places, kinds)):
        if kind < 256:
            c = pixels[k]
        elif kind < 280:
            length, away = refs[k]
            _copy(out, i, length, away)
            for c in out[i : i + length].tolist():
                cache[_cached(c, cache_bits)] = c
            continue
        else:
            c = cache[kind - 280]
        out[i] = c
        cache[_cached(c, cache_bits)] = c
    return out


# ---- transforms, inverted -------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint8 channels in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a, b):
    return ((a.astype(np.int16) + b) >> 1).astype(np.int16)


def _predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """The predicted channels (int16) of one pixel, or of many."""
    if mode == 0 or mode > 13:
        out = np.zeros(np.shape(top), np.int16)
        out[..., 3] = 255
        return out
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        towards_left = np.abs(top - top_left).sum(axis=-1) < np.abs(left - top_left).sum(axis=-1)
        return np.where(towards_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _average(left, top)
    half = mean - top_left
    return np.clip(mean + np.sign(half) * (np.abs(half) >> 1), 0, 255)


def add_prediction(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Residuals (height, width) to pixels; modes: one for each tile of 2**bits."""
    height, width = pixels.shape
    rest = _channels(pixels).astype(np.int16)
    out = np.zeros((height, width, 4), np.int16)
    out[0, 0] = (rest[0, 0] + (0, 0, 0, 255)) & 255
    out[0] = (np.cumsum(np.concatenate([out[:1, 0], rest[0, 1:]]), axis=0)) & 255
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (rest[y, 0] + above[0]) & 255
        row = modes[y >> bits]
        x = 1
        while x < width:
            mode = int(row[x >> bits])
            end = min(width, ((x >> bits) + 1) << bits)
            while end < width and int(row[end >> bits]) == mode:
                end = min(width, end + (1 << bits))
            if mode == 1:
                out[y, x:end] = (np.cumsum(rest[y, x:end], axis=0) + out[y, x - 1]) & 255
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                right = above[x + 1 : end + 1]
                if end == width:  # beyond the last column the first of this row stands in
                    right = np.concatenate([right, out[y, :1]])
                out[y, x:end] = (rest[y, x:end] + _predict(mode, None, above[x:end], above[x - 1 : end - 1], right)) & 255
            else:
                for i in range(x, end):
                    right = above[i + 1] if i + 1 < width else out[y, 0]
                    out[y, i] = (rest[y, i] + _predict(mode, out[y, i - 1], above[i], above[i - 1], right)) & 255
            x = end
    return out.astype(np.uint8).reshape(height, -1).view("<u4").astype(np.uint32)


def _spread(tiles: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]


def _colour_shift(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8)) >> 5


def cross_colour(pixels: np.ndarray, bits: int, tiles: np.ndarray, sign: int = 1) -> np.ndarray:
    """Add (sign 1) or take away (sign -1) what green and red say of red and blue."""
    height, width = pixels.shape
    t = _channels(_spread(tiles, bits, height, width))
    c = _channels(pixels)
    blue, green, red = c[..., 0].astype(np.int32), np.ascontiguousarray(c[..., 1]), c[..., 2].astype(np.int32)
    new_red = (red + sign * _colour_shift(np.ascontiguousarray(t[..., 0]), green)) & 255
    whole_red = new_red if sign > 0 else red
    blue = (blue + sign * (_colour_shift(np.ascontiguousarray(t[..., 1]), green) + _colour_shift(np.ascontiguousarray(t[..., 2]), whole_red))) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << np.uint32(16)) | blue.astype(np.uint32)


def add_green(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    c = _channels(pixels).astype(np.int16)
    c[..., 0] += sign * c[..., 1]
    c[..., 2] += sign * c[..., 1]
    return (c & 255).astype(np.uint8).reshape(*pixels.shape[:-1], -1).view("<u4").astype(np.uint32)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(pixels: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    bits = bundle_bits(len(colours))
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        index = ((index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.uint32)  # indices beyond the palette are transparent black
    table[: len(colours)] = colours
    return table[index]


def decode(data: bytes, fast: bool = True) -> np.ndarray:
    """The pixels (height, width) of a RIFF container with one VP8L image, as uint32 ARGB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise CorruptImage("no lossless WebP")
    r = Reader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.read(8) != 0x2F:
        raise CorruptImage("no VP8L signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise CorruptImage("unknown version")
    steps, inner = [], width
    while r.read(1):
        kind = r.read(2)
        if any(kind == k for k, *_ in steps):
            raise CorruptImage("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            w, h = (inner + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            steps.append((kind, inner, bits, read_pixels(r, w, h, False, fast).reshape(h, w)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            table = read_pixels(r, n, 1, False, fast)
            colours = (np.cumsum(_channels(table), axis=0, dtype=np.int64) & 255).astype(np.uint8).reshape(-1).view("<u4").astype(np.uint32)
            steps.append((kind, inner, 0, colours))
            bits = bundle_bits(n)
            inner = (inner + (1 << bits) - 1) >> bits
        else:
            steps.append((kind, inner, 0, None))
    pixels = read_pixels(r, inner, height, True, fast).reshape(height, inner)
    for kind, w, bits, what in reversed(steps):
        if kind == PREDICTOR:
            pixels = add_prediction(pixels, bits, (what >> 8) & 15)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, bits, what)
        elif kind == SUBTRACT_GREEN:
            pixels = add_green(pixels)
        else:
            pixels = from_palette(pixels, w, what)
    return pixels


# ---- encoding -------------------------------------------------------------------------------------------


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra value, extra bits) of a length or distance code, 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    k = v.bit_length() - 2
    return 2 * k + 2 + ((v >> k) & 1), v & ((1 << k) - 1), k


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _put_tokens(w: Writer, tokens: list[tuple], top: bool, cache_bits: int = 0) -> None:
    """('pixel', argb), ('copy', length, distance code), ('cache', index): codes, then tokens."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    counts: list[dict[int, int]] = [{}, {}, {}, {}, {}]
    rows = []
    for t in tokens:
        if t[0] == "pixel":
            a, red, g, b = t[1] >> 24, t[1] >> 16 & 255, t[1] >> 8 & 255, t[1] & 255
            row = [(0, g), (1, red), (2, b), (3, a)]
        elif t[0] == "copy":
            p, x, k = prefix_of(t[1])
            q, y, m = prefix_of(t[2])
            row = [(0, 256 + p), (None, x, k), (4, q), (None, y, m)]
        else:
            row = [(0, 280 + t[1])]
        rows.append(row)
        for c, s, *_ in (x for x in row if x[0] is not None):
            counts[c][s] = counts[c].get(s, 0) + 1
    codes = [put_code(w, n, size) for n, size in zip(counts, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
    for row in rows:
        for x in row:
            w.put(*(codes[x[0]][x[1]] if x[0] is not None else x[1:]))


def tokens_of(pixels: list[int], width: int, copies: bool, cache_bits: int) -> list[tuple]:
    """Greedy tokens: the nearest earlier run of three or more, else a cached colour, else the pixel."""
    out, seen, cache, i = [], {}, {}, 0
    near = {max(1, dx + dy * width): k for k, (dx, dy) in reversed([*enumerate(NEAR, 1)])}
    while i < len(pixels):
        n, j = 0, seen.get(tuple(pixels[i : i + 3])) if copies else None
        if j is not None:
            while n < 4096 and i + n < len(pixels) and pixels[j + n] == pixels[i + n]:
                n += 1
        if n >= 3:
            out.append(("copy", n, near.get(i - j, i - j + 120)))
        else:
            n = 1
            key = _cached(pixels[i], cache_bits) if cache_bits else None
            out.append(("cache", key) if cache_bits and cache.get(key) == pixels[i] else ("pixel", pixels[i]))
        for k in range(i, i + n):
            seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[_cached(pixels[k], cache_bits)] = pixels[k]
        i += n
    return out


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def _put_palette(w: Writer, colours: np.ndarray) -> None:
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    c = _channels(colours).astype(np.int16)
    steps = (np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int16)) & 255).astype(np.uint8).reshape(-1).view("<u4")
    _put_tokens(w, [("pixel", int(x)) for x in steps], False)


def to_palette(pixels: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Pixels (height, width) as bundled indices; colours sorted."""
    index = np.searchsorted(colours, pixels).astype(np.uint32)
    bits = bundle_bits(len(colours))
    if bits:
        each, height = 8 >> bits, len(index)
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bits)))).reshape(height, -1, 1 << bits)
        index = (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))).sum(axis=2, dtype=np.uint32)
    return (index << np.uint32(8)) | np.uint32(0xFF000000)


def encode(pixels: np.ndarray, palette: bool = False, subtract_green: bool = False, cross: np.ndarray | None = None, modes: np.ndarray | None = None, bits: int = 2, copies: bool = False, cache_bits: int = 0) -> bytes:
    """A lossless WebP of the pixels (height, width), with the transforms asked for.

    modes: a predictor mode for each tile of 2**bits pixels; cross: a cross-colour element for each.
    Pixel by pixel, so for images of moderate size; `encode_samples` is the bulk path.
    """
    height, width = pixels.shape
    w = _start(width, height)
    if palette:
        colours = np.unique(pixels)
        _put_palette(w, colours)
        pixels = to_palette(pixels, colours)
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        pixels = add_green(pixels, -1)
    for kind, tiles in ((CROSS_COLOUR, cross), (PREDICTOR, modes)):
        if tiles is None:
            continue
        tiles = np.asarray(tiles, np.uint32)
        w.put(1, 1)
        w.put(kind, 2)
        w.put(bits - 2, 3)
        shown = tiles if kind == CROSS_COLOUR else (tiles << np.uint32(8)) | np.uint32(0xFF000000)
        _put_tokens(w, [("pixel", int(x)) for x in shown.reshape(-1)], False)
        pixels = cross_colour(pixels, bits, tiles, -1) if kind == CROSS_COLOUR else _residuals(pixels, bits, tiles)
    w.put(0, 1)
    _put_tokens(w, tokens_of(pixels.reshape(-1).tolist(), pixels.shape[1], copies, cache_bits), True, cache_bits)
    return container(pack(*w.arrays()))


def _residuals(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    c = _channels(pixels).astype(np.int16)
    out = np.zeros_like(c)
    for y in range(height):
        for x in range(width):
            if x == 0 or y == 0:
                guess = np.array((0, 0, 0, 255), np.int16) if x == y == 0 else c[y, x - 1] if y == 0 else c[y - 1, 0]
            else:
                guess = _predict(int(modes[y >> bits][x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], c[y - 1, x + 1] if x + 1 < width else c[y, 0])
            out[y, x] = (c[y, x] - guess) & 255
    return out.astype(np.uint8).reshape(height, -1).view("<u4").astype(np.uint32)


def repeated_lines(samples: bytes, least: int = 24) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that an earlier, equal line can stand for."""
    if samples.count(b"\n") < 2:
        return []
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in samples.split(b"\n"):
        n = len(line)
        if n >= least:
            if (before := seen.get(line)) is not None:
                out.append((at, n, at - before))
            seen[line] = at
        at += n + 1
    return out


def encode_samples(samples: bytes, width: int) -> bytes:
    """8-bit samples (a multiple of width) as a grey lossless WebP: the sample is each pixel's green.

    At most 16 sample values: a palette, several pixels bundled in one. Otherwise one prefix code over the
    samples, with back-references for repeated lines.
    """
    height = len(samples) // width
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    w = _start(width, height)
    copies: list[tuple[int, int, int]] = []
    if np.count_nonzero(counts) <= 16:
        colours = (np.flatnonzero(counts).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
        _put_palette(w, colours)
        a = ((to_palette((a.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(height, width), colours) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).reshape(-1)
    else:
        copies = repeated_lines(samples)
    w.put(0, 1)  # no more transforms
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one prefix group
    if copies:
        plain = np.ones(len(a) + 1, np.int8)
        edges = np.zeros(len(a) + 1, np.int32)
        for at, n, _ in copies:
            edges[at] += 1
            edges[at + n] -= 1
        plain = np.cumsum(edges)[:-1] == 0
        a_kept = a[plain]
        cuts = [(at + k, min(4096, n - k), d) for at, n, d in copies for k in range(0, n, 4096)]
    else:
        a_kept, cuts = a, []
    counts = np.bincount(a_kept, minlength=256)
    green = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    far: dict[int, int] = {}
    parts = []
    for at, n, d in cuts:
        p, q = prefix_of(n), prefix_of(d + 120)
        green[256 + p[0]] = green.get(256 + p[0], 0) + 1
        far[q[0]] = far.get(q[0], 0) + 1
        parts.append((at, p, q))
    codes = put_code(w, green, 280)
    for c in ({0: 1}, {0: 1}, {255: 1}):
        put_code(w, c, 256)
    away = put_code(w, far, 40)
    code = np.zeros(256, np.uint32)
    length = np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        if s < 256:
            code[s], length[s] = c, n
    head, head_lengths = w.arrays()
    values, lengths = code[a_kept], length[a_kept]
    if cuts:
        # What stands where a copy stands: its prefix, extra bits, distance prefix, extra bits.
        before = np.searchsorted(np.flatnonzero(plain), [x[0] for x in parts])
        put_v, put_n = [], []
        for _, p, q in parts:
            put_v += [codes[256 + p[0]][0], p[1], away[q[0]][0], q[1]]
            put_n += [codes[256 + p[0]][1], p[2], away[q[0]][1], q[2]]
        where = np.repeat(before, 4)
        values, lengths = np.insert(values, where, np.array(put_v, np.uint32)), np.insert(lengths, where, put_n)
    return container(pack(np.concatenate([np.array(head, np.uint32), values]), np.concatenate([np.array(head_lengths, np.int64), lengths])))
