"""Token counts by finite-state transducers compiled from a tokenizer file.

Two deterministic transducers, one after the other:

* The pre-tokeniser reads character classes and marks where pre-tokens start. It has seven states. A batch of
  texts is cut into chunks; for each chunk the map from every start state to its end state is computed (all
  chunks in lockstep); the maps are composed by a parallel prefix scan, which gives each chunk's true start
  state; a last pass emits the marks.
* The counter reads a pre-token's byte symbols, the last one marked as such. Its transitions carry the number
  of tokens by which the encoding of the prefix grows (or shrinks, where a longer merge takes over). A state
  is what the rest of the pre-token can still depend on: the begun vocabulary tokens (trie nodes), with the
  token before each and the count there. Byte pair encodings are exactly the token sequences each of whose
  neighbouring pairs would be kept by the merges, so one table of valid pairs drives all transitions.
  States are compiled when first met and kept in a bounded table; all pre-tokens run in lockstep.

Counting needs no token ids and no merging at run time.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm import libraryclasses
from palimpsest.llm.common import emit, slices, texts
from palimpsest.llm.libraryclasses import classes, code_points, unlike_python
from palimpsest.llm.packing import byte_alphabet

PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E = range(10)
BETWEEN, LETTERS, RUN, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
N_STATES, N_CLASSES = 7, 10
HERE, BEFORE = 1, 2
CHUNK = 512
#: Characters that are normalised at a time.
PIECE = 1 << 18
#: Compiled transitions kept by a worker (16 bytes each in the table); the counter starts over when full.
MOST = 1_500_000


def pretoken_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by class * N_STATES + state. Marks: a pre-token starts HERE, or one character BEFORE."""
    to = np.zeros((N_CLASSES, N_STATES), np.uint8)
    mark = np.zeros((N_CLASSES, N_STATES), np.uint8)
    for c in range(N_CLASSES):
        letter = c in (LETTER, STMD, R, V, L, E)
        fresh = {SPACE: (BETWEEN, 0), NUMBER: (BETWEEN, HERE), OTHER: (RUN, HERE), QUOTE: (QUOTED, HERE)}.get(c, (LETTERS, HERE))
        for s in range(N_STATES):
            if s == BETWEEN:
                step = fresh
            elif s == LETTERS:
                step = (LETTERS, 0) if letter else fresh
            elif s == RUN:
                step = (RUN, 0) if c in (OTHER, QUOTE) else fresh
            elif s == QUOTED:
                step = {STMD: (BETWEEN, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0), OTHER: (RUN, 0), QUOTE: (RUN, 0)}.get(c, fresh)
            elif c == (L if s == QUOTED_L else E):
                step = (BETWEEN, 0)
            else:  # the quote stood alone, and the letter after it began a run of letters
                step = (LETTERS, BEFORE) if letter else (fresh[0], fresh[1] | BEFORE)
            to[c, s], mark[c, s] = step
    return to.reshape(-1), mark.reshape(-1)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, as the library's own pattern engine has it."""
    out = np.full(0x110000, OTHER, np.uint8)
    own = classes("tokenizers")
    for k, mine in ((libraryclasses.LETTER, LETTER), (libraryclasses.NUMBER, NUMBER), (libraryclasses.SPACE, SPACE)):
        out[own == k] = mine
    out[[ord(c) for c in "stmd"]] = STMD
    for c, k in zip("'rvle", (QUOTE, R, V, L, E)):
        out[ord(c)] = k
    return out


def normal(text: str) -> str:
    """The text in NFC and lower case, as the library makes it; white space is left as it is.

    Python does both where it treats every character of a piece as the library does, the library elsewhere. Pieces
    begin at a line feed or space, which no composition reaches across.
    """
    out, at = [], 0
    while at < len(text):
        end = len(text) if len(text) - at <= 2 * PIECE else max(text.rfind("\n", at + 1, at + PIECE), text.rfind(" ", at + 1, at + PIECE))
        piece = text[at : end if end > 0 else len(text)]
        at += len(piece)
        if not piece.isascii() and unlike_python()[code_points(piece)].any():
            out.append(_library_normal().normalize_str(piece))
        else:
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            out.append(piece.replace("Σ", "σ").lower())  # final sigma has no lower case of its own here
    return "".join(out)


@lru_cache(maxsize=1)
def _library_normal():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks, states): row i becomes the map over chunks 0 to i."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return maps


def pretoken_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens start. classes must end with SPACE."""
    to, mark = pretoken_tables()
    n = len(classes)
    rows = -(-n // chunk)
    steps = np.zeros(rows * chunk, np.uint8)  # padded with SPACE
    steps[:n] = classes
    steps = np.ascontiguousarray(steps.reshape(rows, chunk).T).astype(np.uint8) * np.uint8(N_STATES)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for row in steps:
        maps = to[row[:, None] + maps]
    state = np.concatenate([[BETWEEN], compose(maps)[:-1, BETWEEN]]).astype(np.uint8)
    marks = np.empty((chunk, rows), np.uint8)
    for j, row in enumerate(steps):
        key = row + state
        marks[j] = mark[key]
        state = to[key]
    marks = marks.T.reshape(-1)[:n]
    start = (marks & HERE).astype(bool)
    start[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(start)


class Counter:
    """The counting transducer of a byte pair encoding with end-of-word symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers")
        suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if not pre or kinds != ["NFC", "Replace", "Lowercase"] or pre[0]["pattern"] != {"Regex": PATTERN} or pre[1]["type"] != "ByteLevel" or not suffix:
            raise ValueError("not the kind of tokenizer that this transducer is compiled for: " + path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        byte = byte_alphabet()

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            own = [byte[c] for c in (token[: -len(suffix)] if ends else token)]
            return (*own[:-1], own[-1] + 256 * ends)

        # Tokens are numbered by rank: the 512 symbols, then the merges in their order.
        number = {(s,): s for s in range(512)}
        self.parts: list[tuple[int, int]] = [(s, s) for s in range(512)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (symbols(x) for x in (m.split(" ") if isinstance(m, str) else m))
            number.setdefault(a + b, len(self.parts))
            self.merged[number[a], number[b]] = number[a + b]
            self.parts.append((number[a], number[b]))
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, t in number.items():
            node = 0
            for s in word:
                nxt = self.child[node].get(s)
                if nxt is None:
                    nxt = self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = t
        self.pairs: dict[tuple[int, int], bool] = {}
        self.start_over()

    def start_over(self) -> None:
        self.states: dict[tuple, int] = {}
        self.inside: list[tuple] = []
        self.n = 0
        self._room(1 << 16)
        self.first = self._state(((0, -1, 0),))

    def _state(self, inside: tuple) -> int:
        k = self.states.get(inside)
        if k is None:
            k = self.states[inside] = len(self.inside)
            self.inside.append(inside)
        return k

    def valid(self, a: int, b: int) -> bool:
        """Whether the merges keep the boundary between tokens a and b; a = -1: whether they make b whole."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST:
                self.pairs.clear()
            known = self.pairs[a, b] = self._whole(b) if a < 0 else self._kept(a, b)
        return known

    def _whole(self, t: int) -> bool:
        left, right = self.parts[t]
        return left == right == t and t < 512 or t >= 512 and self.merged[left, right] == t and self.valid(-1, left) and self.valid(-1, right) and self._inner(t)

    def _inner(self, t: int) -> bool:
        """Merge t's symbols by rank; t is whole if it is what comes out."""
        stack, out = [t], []
        while stack:
            x = stack.pop()
            if x < 512:
                out.append(x)
            else:
                stack += reversed(self.parts[x])
        while len(out) > 1:
            best = min((m, i) for i, m in ((i, self.merged.get((out[i], out[i + 1]), 1 << 30)) for i in range(len(out) - 1)))
            if best[0] == 1 << 30:
                return False
            m, (x, y) = best[0], self.parts[best[0]]
            i, new = 0, []
            while i < len(out):
                if i + 1 < len(out) and out[i] == x and out[i + 1] == y:
                    new.append(m)
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out == [t]

    def _kept(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the boundary, latest first; no earlier merge may cross it."""
        limit = 1 << 30
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    limit = a
                    a = self.parts[a][1]
                    if a != limit:
                        break
                else:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 != limit:
                        break
                undo_left = not undo_left
            else:
                return True

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens added) on a symbol."""
        begun, last, added = [], -1, 0
        for node, before, count in self.inside[state]:
            nxt = self.child[node].get(symbol)
            if nxt is None:
                continue
            t = self.token[nxt]
            if last < 0 and t >= 0 and self.valid(before, t):
                last, added = t, count + 1
            if self.child[nxt]:
                begun.append((nxt, before, count))
        if last < 0:
            raise AssertionError("every prefix has an encoding")
        if symbol >= 256:
            return self.first, added
        return self._state((*((n, b, c - added) for n, b, c in begun), (0, last, 0))), added

    # ---- the table of compiled transitions: open addressing over arrays, looked up many at a time

    def _room(self, size: int) -> None:
        old = (self.keys, self.next, self.adds) if self.n else None
        self.size, self.shift = size, np.uint64(64 - size.bit_length() + 1)
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.adds = np.zeros(size, np.int32)
        if old:
            for i in np.flatnonzero(old[0] >= 0).tolist():
                self._put(int(old[0][i]), int(old[1][i]), int(old[2][i]))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, key: int, state: int, added: int) -> None:
        i = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[i] >= 0:
            i = (i + 1) & (self.size - 1)
        self.keys[i], self.next[i], self.adds[i] = key, state, added

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 - slot where a key is missing."""
        slot = self._slot(keys)
        got = self.keys[slot]
        todo = np.flatnonzero(got != keys)
        while len(todo):
            missing = got[todo] < 0
            if missing.any():
                gone = todo[missing]
                slot[gone] = -1 - slot[gone]
                todo = todo[~missing]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            got[todo] = self.keys[slot[todo]]
            todo = todo[got[todo] != keys[todo]]
        return slot

    def count(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token symbols[start : start + length] (bytes), in lockstep."""
        out = np.zeros(len(starts), np.int64)
        if self.n > MOST:
            self.start_over()
        order = np.argsort(-lengths, kind="stable")
        begin, length = starts[order], lengths[order]
        active = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), side="right")
        state = np.full(len(order), self.first, np.int64)
        total = np.zeros(len(order), np.int64)
        for j, m in enumerate(active.tolist()):
            key = state[:m] * 512 + symbols[begin[:m] + j] + 256 * (length[:m] == j + 1)
            slot = self._find(key)
            if (slot < 0).any():
                for k in np.unique(key[slot < 0]).tolist():
                    self._put(k, *self.compile(k >> 9, k & 511))
                    self.n += 1
                    if 2 * self.n > self.size:
                        self._room(2 * self.size)
                slot = self._find(key)
            state[:m] = self.next[slot]
            total[:m] += self.adds[slot]
        out[order] = total
        return out

    def counts(self, many: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(many), np.int64)
        plain = []
        for i, t in enumerate(many):
            if self.special is not None and "<" in t:
                parts = self.special.split(t)
                if len(parts) > 1:
                    extra[i] = len(parts) - 1
                    t = " ".join(parts)
            plain.append(t.lower() if t.isascii() else normal(t))
        whole = " ".join(plain) + " "
        if whole.isascii():
            symbols = np.frombuffer(whole.encode(), np.uint8)
            classes, lead = class_table()[symbols], None
        else:
            symbols = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
            classes = class_table()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
            lead = np.flatnonzero((symbols & 0xC0) != 0x80)
        starts = pretoken_starts(classes)
        if not len(starts):
            return extra
        stop = classes == SPACE
        stop[starts] = True
        stops = np.append(np.flatnonzero(stop), len(classes) - 1)
        ends = stops[np.searchsorted(stops, starts, side="right")]
        texts_at = np.cumsum([0] + [len(t) + 1 for t in plain])
        of = np.searchsorted(texts_at, starts, side="right") - 1
        if lead is not None:
            starts, ends = lead[starts], lead[ends]
        n = self.count(symbols.astype(np.int64), starts, ends - starts)
        return extra + np.bincount(of, n, len(many)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One compiled counter per worker process and file."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: n_tokens > limit), one row per input row.

    A null text counts as empty: no bytes, no tokens. Special strings inside a text count as one token each,
    as the library's default has it. Rows with null or repeated ids keep their row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    tables = libraryclasses.packed("tokenizers", "unlike_python")

    def run(batches):
        libraryclasses.install(tables)
        c = counter(path)
        for b in slices(batches, most_bytes=2 << 20):
            own = [t or b"" for t in b.column(1).to_pylist()]
            n = c.counts([t.decode("utf-8", "replace") for t in own])
            yield emit(schema, {"doc_id": b.column(0).cast(pa.int64()), "n_bytes": [len(t) for t in own], "n_tokens": n, "over_limit": n > limit})

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
