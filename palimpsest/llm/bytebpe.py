"""Byte-level BPE encoding and decoding over overlapping chunks.

A long text is cut into chunks of `CHUNK` code points, each with an overlap on its right, and every chunk is a row of
its own: tasks pre-tokenise and encode chunks in parallel. A task knows both scans of the overlap, its own and the one
that the next chunk begins afresh. From the first boundary that both have, they agree for good, because a match of
the pattern depends only on where it starts and on what follows. There the chunk ends, and there the next one is joined
on: each chunk notes at which of its first boundaries which of its ids begin. The last two matches before a chunk's
end are not trusted, as they could go on.

Where an overlap has no common boundary (one pre-token longer than the overlap, say), the text is pre-tokenised by one
task, which scans on from a chunk's last boundary to the first one that the next chunk has.

The pattern is run by the `regex` module, on texts in which stand-ins make it see the classes that the library's own
engine sees (`libraryclasses`). Pieces are encoded by merge ranks; a decoder concatenates token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import emit, pick, slices, stored, texts
from palimpsest.llm.libraryclasses import alike, install, packed, properties_only

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Pre-tokens remembered by a worker, with their ids; the memory is emptied when full.
REMEMBERED = 200_000
#: Longer pre-tokens are not remembered.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def scan(pattern: regex.Pattern, window: str, step: int, last: bool) -> tuple[list[int], int | None]:
    """Match starts of one chunk, and where it ends: at the first boundary that the next chunk's own scan has as well.

    window: the chunk and its overlap; the next chunk begins at `step`. The last chunk ends with its text. None: the
    overlap has no common boundary.
    """
    starts = [m.start() for m in pattern.finditer(window)]
    if last:
        return starts, len(window)
    fresh = {m.start() for m in pattern.finditer(window, step)}
    end = next((s for s in starts[:-2] if s >= step and s in fresh), None)
    return ([s for s in starts if s < end] if end is not None else []), end


def pretokens(pattern: regex.Pattern, text: str, seen: str | None = None) -> list[str]:
    """The pattern's matches, which must leave no gap; with `seen`, they are found there and cut from text."""
    if seen is None or seen is text:
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(seen)]


class Codec:
    """Encoder and decoder over one rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        if not properties_only(pattern):
            raise ValueError("a pattern of properties that the engines are not compared on: " + pattern)
        ranks = read_ranks(path)
        self.pattern, self.alike = regex.compile(pattern), alike("tiktoken")
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.core.encode_single_piece(piece.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _ids(self, pieces: list[str]) -> list[bytes]:
        known, piece = self.known.get, self._piece
        return [known(p) or piece(p) for p in pieces]

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        return b"".join(self._ids(pretokens(self.pattern, text, self.alike(text))))

    def encode_chunk(self, window: str, step: int, overlap: int, last: bool) -> tuple[bytes, bytes, int | None]:
        """The ids of one chunk, which of its first boundaries begin which of them, and where it ends (see `scan`).

        The boundaries are pairs of 32-bit numbers: a place up to `overlap`, and the bytes of ids before it.
        """
        starts, end = scan(self.pattern, self.alike(window), step, last)
        if end is None:
            return b"", b"", None
        ids = self._ids([window[x:y] for x, y in zip(starts, [*starts[1:], end])])
        n = np.searchsorted(starts, overlap, side="right") if starts else 0
        before = np.cumsum([0, *map(len, ids[:n])])[: n + 1]
        places = [*starts[:n], *([end] if n == len(starts) else [])]
        return b"".join(ids), np.array([places, before[: len(places)]], "<u4").T.tobytes(), end

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def joined(chunks: list[tuple[bytes, bytes, int | None]], step: int) -> bytes | None:
    """The ids of a text from those of its chunks in order (`encode_chunk`); None where two have no common boundary."""
    out, begin = [], 0
    for ids, head, end in chunks:
        if end is None:
            return None
        at = dict(np.frombuffer(head, "<u4").reshape(-1, 2).tolist()) if begin else {0: 0}
        if begin not in at:
            return None
        out.append(ids[at[begin] :])
        begin = end - step
    return b"".join(out)


TABLES = ("tiktoken", "regex")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, tables: bytes | None = None) -> Codec:
    """One codec per worker process and file; tables: what the driver `packed` of TABLES."""
    if tables is not None:
        install(tables)
    return Codec(path, pattern)


def _whole(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of texts (doc_id, text as bytes), each encoded by one task."""
    schema, tables = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), packed(*TABLES)

    def run(batches):
        c = codec(path, pattern, tables)
        for b in slices(batches):
            yield emit(schema, {"doc_id": b.column(0).cast(pa.int64()), "ids": [c.encode((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]})

    return df.mapInArrow(run, "doc_id long, ids binary")


def _chunked(df: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of long texts (doc_id, text), chunk by chunk: rows of equal id and text are encoded once."""
    text, n = F.col("text"), F.char_length("text")
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("h0"), F.xxhash64(text, F.lit(1)).alias("h1"))
    cut = keyed.select("doc_id", "h0", "h1", n.alias("n"), "text", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / chunk) - 1, F.lit(0)).cast("int"))).alias("k", "_"))
    window = F.substring(text, F.col("k") * chunk + 1, F.lit(chunk + overlap))
    rows = cut.select("doc_id", "h0", "h1", "k", ((F.col("k") + 1) * chunk + overlap >= F.col("n")).alias("last"), window.alias("text"))
    rows = rows.repartition("h0", "k")
    names, tables = ["doc_id", "h0", "h1", "k"], packed(*TABLES)
    schema = pa.schema([("doc_id", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("k", pa.int32()), ("ids", pa.binary()), ("head", pa.binary()), ("end", pa.int64())])

    def run(batches):
        c = codec(path, pattern, tables)
        for b in slices(batches):
            done = [c.encode_chunk(t, chunk, overlap, last) for t, last in zip(b.column("text").to_pylist(), b.column("last").to_pylist())]
            yield emit(schema, {m: b.column(m) for m in names} | {"ids": [x[0] for x in done], "head": [x[1] for x in done], "end": [x[2] for x in done]})

    coded = rows.mapInArrow(run, "doc_id long, h0 long, h1 long, k int, ids binary, head binary, end long")
    once = coded.groupBy(*names).agg(F.first(F.struct("ids", "head", "end")).alias("c"), F.count("*").alias("copies"))
    texts_of = once.groupBy("doc_id", "h0", "h1").agg(F.sort_array(F.collect_list(F.struct("k", "c.ids", "c.head", "c.end"))).alias("chunks"), F.max("copies").alias("copies"))
    whole = pa.schema([("doc_id", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("copies", pa.int64()), ("ids", pa.binary())])

    def join(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                [parts] = b.column("chunks").to_pylist()
                yield emit(whole, {m: b.column(m) for m in ("doc_id", "h0", "h1", "copies")} | {"ids": [joined([(p["ids"], p["head"], p["end"]) for p in parts], chunk)]})

    out = stored(texts_of.select("doc_id", "h0", "h1", "copies", "chunks").mapInArrow(join, "doc_id long, h0 long, h1 long, copies long, ids binary"), "bpe-long")
    found = out.where("ids is not null").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "ids")
    left = out.where("ids is null").select("doc_id", "h0", "h1")
    if left.isEmpty():
        return found
    same = keyed["doc_id"].eqNullSafe(left["doc_id"]) & (keyed["h0"] == left["h0"]) & (keyed["h1"] == left["h1"])
    rest = keyed.join(left, same, "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
    return found.unionAll(_whole(rest, path, pattern))


def _split(df: DataFrame, id_col: str, text_col: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) rows: those short enough for one chunk, as bytes, and the others; None where there are none."""
    own = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    is_long = F.octet_length("text") > chunk + overlap
    short = own.where(~F.coalesce(is_long, F.lit(False))).select("doc_id", F.col("text").cast("binary").alias("text"))
    rest = own.where(is_long)
    return short, None if rest.isEmpty() else rest


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit), one row per input row; null text: no ids.

    Every special string inside a text is ordinary text. Rows with null or repeated ids keep their row. An empty table
    gives no rows.
    """
    short, rest = _split(df, id_col, text_col, chunk, overlap)
    done = _whole(short, path, pattern)
    return done if rest is None else done.unionAll(_chunked(rest, path, pattern, chunk, overlap))


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for; null ids count as none."""
    schema, tables = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]), packed(*TABLES)

    def run(batches):
        c = codec(path, pattern, tables)
        for b in slices(batches):
            ids = [x or b"" for x in b.column(1).to_pylist()]
            yield emit(schema, {"doc_id": b.column(0).cast(pa.int64()), "ids": ids, "decoded": [c.decode(x) for x in ids]})

    return texts(df, id_col, ids_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode, for checks and reports.

    Short texts are encoded and decoded in one pass. Rows as in `encode`.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    kinds, tables = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", packed(*TABLES)

    def run(encoded: bool):
        def over(batches):
            c = codec(path, pattern, tables)
            for b in slices(batches, b_name):
                ids = [x or b"" for x in b.column(1).to_pylist()] if encoded else [c.encode((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
                yield emit(schema, {"doc_id": b.column(0).cast(pa.int64()), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]})

        b_name = "ids" if encoded else "text"
        return over

    short, rest = _split(df, id_col, text_col, chunk, overlap)
    done = short.mapInArrow(run(False), kinds)
    return done if rest is None else done.unionAll(_chunked(rest, path, pattern, chunk, overlap).mapInArrow(run(True), kinds))
