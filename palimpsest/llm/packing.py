"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Bulk-synchronous best fit, longest documents first. Documents are sorted into classes by length, gaps into
classes by size; both have at most `capacity` classes, whatever the number of documents. A round takes the
longest class that is left and sweeps upward from the smallest gap that holds it (its successor): the
document of rank r goes to the gap of rank r in that order, so no two want the same gap. Then the gaps are
updated and the next round begins. A class that finds no gap opens sequences, as few as it could fill.

A round needs only class sizes and runs of equal gaps, so rounds run on those bounded tables; documents take
part by rank. Ranks are distributed: each task numbers its own pieces by length, and one window over the
(task, length) counts gives the offsets. Every document then looks up the run that its rank falls in.
Pieces are tokenised once and written to the shared folder before any of this.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bytebpe import pretokens
from palimpsest.llm.common import slices, stored, texts
from palimpsest.llm.libraryclasses import alike, classes, code_points, install, packed

CAPACITY = 1024
#: The plan is broadcast up to this many rows (40 bytes each); beyond, it is joined by shuffle. Its size follows
#: from the capacity alone: some 7,000 rows for 10**10 documents of all lengths up to 1024.
BROADCAST_ROWS = 100_000
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return out


class Encoder:
    """A byte-level BPE of a tokenizer .json, with its special strings as that library handles them."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level BPE: " + path)
        byte = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern, self.alike = regex.compile(BYTE_LEVEL), alike("tokenizers")
        self.unlike = classes("tokenizers") != classes("tiktoken")
        self.encoding = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or not self.unlike[code_points(text)].any():
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        # The engine that cuts fast sees some of these characters otherwise than the library does.
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for p in pretokens(self.pattern, part, self.alike(part)):
                    out += self.encoding._core_bpe.encode_single_piece(p.encode())
        return np.array(out, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, tables: bytes) -> Encoder:
    """One encoder per worker process and file; tables: what the driver `packed`."""
    install(tables)
    return Encoder(path)


def pieces(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank_in_part[, ids]) of every document.

    A document is its ids and `end_id`; only one longer than `capacity` is cut, the first piece being the
    shorter one. Null text: empty, hence one piece with the end id. Repeated and null ids keep their rows.
    part and rank_in_part number the pieces of one length within one task.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank_in_part", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []
    schema = pa.schema(fields)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + ", ids array<int>" * keep_ids

    tables = packed("tiktoken", "tokenizers", "regex")

    def run(batches):
        enc, part, seen = encoder(path, tables), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches):
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(enc.ids((text or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) - (len(ids) - 1) // capacity * capacity, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[x:y]
                    row = [doc, k, x, y - x, zlib.crc32(own), part, seen[y - x]]
                    seen[y - x] += 1
                    for c, v in zip(out, row + [own.tolist()] * keep_ids):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], schema=schema)

    return texts(df, id_col, text_col).mapInArrow(run, kinds)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The rounds over class sizes: ((length, rank_lo, rank_hi, sequence_lo, offset) rows, sequences opened).

    Documents of `length` with ranks in [rank_lo, rank_hi) go to consecutive sequences from sequence_lo on.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            gaps = sorted(g for g in runs if g >= length)
            if not gaps:
                n = -(-left // (capacity // length))
                runs.setdefault(capacity, []).append((opened, n))
                opened += n
                gaps = [capacity]
            moved: list[tuple[int, tuple[int, int]]] = []
            for gap in gaps:  # the successor sweep: ranks meet gaps in rising order
                own = runs[gap]
                while own and left:
                    first, n = own.pop()
                    take = min(n, left)
                    plan.append((length, rank, rank + take, first, capacity - gap))
                    moved.append((gap - length, (first, take)))
                    if take < n:
                        own.append((first + take, n - take))
                    rank += take
                    left -= take
                if not own:
                    del runs[gap]
                if not left:
                    break
            for gap, run in moved:  # gaps change only once the round is over
                if gap:
                    runs.setdefault(gap, []).append(run)
    return plan, opened


def pack(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each piece with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Sequences are numbered from 0; offsets are gapless from 0 within each. An empty table gives no rows.
    """
    spark = df.sparkSession
    cut = stored(pieces(df, path, end_id, capacity, id_col, text_col, keep_ids), "packing")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    sizes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = sweep(sizes, capacity)
    # A merge join at every size: there are as many offsets as tasks times lengths.
    ranked = cut.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    fields = "length long, rank_lo long, rank_hi long, sequence_lo long, place long"
    columns = list(zip(*plan)) if plan else [()] * 5
    rows = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in fields.split(", ")]))
    if len(plan) <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    placed = ranked.join(rows, (ranked["length"] == rows["length"]) & (F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi")))
    out = [cut["doc_id"], "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence_lo") + F.col("rank") - F.col("rank_lo")).alias("sequence_id"), F.col("place").alias("offset")]
    return placed.select(*out, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, tokens): the training sequences themselves, from pack(..., keep_ids=True).

    A sequence gathers at most `capacity` tokens, hence at most that many pieces.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("tokens"))
