"""SimHash near-duplicate detection with pivot distance tables.

A fingerprint is a majority vote over the hashes of a text's word shingles, bit by bit. Two fingerprints link
when few of their bits differ, and a document's class is its connected component under those links. Exact
copies share a fingerprint and are one node of that graph.

Within each candidate key the pivot table decides: the Hamming distances of every fingerprint to many
reference fingerprints are precomputed; a pair whose largest coordinate difference exceeds the allowed number
of bits is discarded (triangle inequality), and only survivors are verified by XOR and popcount. A key's
members yield spanning links (at most members - 1), never all pairs.

Candidate keys, by the kind of search:

* `near_duplicates`: links at `max_bits` or fewer of 64 bits, exactly. The bits are cut into `max_bits + EXTRA`
  blocks; fingerprints that near agree on at least EXTRA whole blocks, so each distinct fingerprint is filed
  under every choice of EXTRA blocks (7 blocks: 35 keys of 27 or 28 bits).
* `similar`: links at a Jaccard similarity of the shingle sets. Two sets of similarity s differ in the share
  acos(2s / (1 + s)) / pi of their fingerprints' bits. No block scheme reaches that far, so each fingerprint of
  256 bits is filed under sampled bits, in as many tables as it takes to meet a pair at the threshold, and a standard
  error off, with probability RECALL, and a closer one almost surely. Members of a key that are near enough to be worth a look
  yield a minimum spanning forest of bit distances, whose links the exact similarity of the two shingle sets verifies.
  A forest spans bit distances, not similarities: where a key holds more near pairs than its forest has links, and the
  verified links leave its members in several components, every near pair between two of them is verified as well
  (`crossing`), in the first table where it meets. At that radius pivot coordinates never differ by enough to discard a
  pair, so the table serves the first search alone.

Crowded keys (one family of near copies may hold a third of all rows) are cut into tiles of TILE members; every
pair of tiles is a row group of its own, dealt to its own task, so no task ever holds more than two
tiles of a key and no pair is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import emit, numbered, position, slices, stored, texts

SEED = 42
MAX_BITS = 4
EXTRA = 3
TILE = 4096
N_PIVOTS = 24
RECALL = 0.995
#: Neighbours of a node that one task takes (16 bytes each).
HUB = 1 << 20
LONG_WORDS = 4
_DRAWN = np.random.default_rng(20240229)
#: Reference fingerprints and word mixers: fixed, so that every task builds the same tables.
PIVOTS = _DRAWN.integers(0, 2**64, (N_PIVOTS, LONG_WORDS), dtype=np.uint64)
MIXERS = _DRAWN.integers(0, 2**64, LONG_WORDS, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4, words: int = 1) -> np.ndarray:
    """The SimHash of one text, `words` 64-bit numbers; 0 without words, a shorter sequence is one shingle.

    One number is the majority over XXH64 of all shingles, repeats included; several are majorities over the
    distinct shingles, the further ones over hashes mixed from the first.
    """
    own = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not own:
        return np.zeros(words, np.uint64)
    digest, seed, line = xxhash.xxh64_intdigest, SEED, b" ".join(own)
    if len(own) <= shingle:
        begins, ends = [0], [len(line)]
    else:
        starts = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        begins = [0, *starts[: len(own) - shingle].tolist()]
        ends = (starts[shingle - 1 :] - 1).tolist()
    del own
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins, ends)), np.uint64, len(begins))
    if words > 1:  # compared as sets
        h = np.unique(h)
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 255):  # sums of 255 bits fit a byte
        part = _mixed(h[i : i + 255], words)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    if words == 1:
        return h[:, None].copy()
    z = h[:, None] + MIXERS[None, :words]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = h
    return z


def node_of(fps: np.ndarray) -> np.ndarray:
    """The signed 64-bit name of fingerprints (rows): the number itself, or a hash of several."""
    if fps.shape[1] == 1:
        return np.ascontiguousarray(fps[:, 0]).view(np.int64)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in fps], dtype=np.uint64).view(np.int64)


def _columns(words: int) -> list[str]:
    return [f"f{i}" for i in range(words)]


def text_hash(text) -> Column:
    """With the id it names a row, but for exact copies of it; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, node, h, f0, f1, ...): one row per input row. A null text counts as empty (fingerprint 0).

    node names the fingerprint in one number; h is the text's hash.
    """
    names = ["doc_id", "node", "h", *_columns(words)]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t or b"", shingle, words) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(node_of(fps)), b.column(2), *(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(words))], schema=schema)

    return texts(df, id_col, text_col).withColumn("h", text_hash(F.col("text"))).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def block_masks(max_bits: int = MAX_BITS, extra: int = EXTRA) -> list[int]:
    """One 64-bit mask for each choice of `extra` of the `max_bits + extra` blocks."""
    k = max_bits + extra
    edges = [round(64 * i / k) for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def by_blocks(nodes: DataFrame, max_bits: int = MAX_BITS, extra: int = EXTRA) -> DataFrame:
    """(key, f0): each fingerprint under every choice of blocks. A key is a 64-bit hash of choice and bits.

    Should two keys share a name, their members only meet more pairs to verify.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("f0").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(block_masks(max_bits, extra))])
    # As many rows as keys leave each row: spread first, as distinct nodes come in few partitions.
    spread = nodes.select("f0").repartition(nodes.sparkSession.sparkContext.defaultParallelism * 4, "f0")
    return spread.select("f0", F.explode(keys).alias("key")).select(F.xxhash64("key.k", "key.v").alias("key"), "f0")


def bit_tables(n: int, differ: float, words: int = LONG_WORDS, recall: float = RECALL) -> list[np.ndarray]:
    """Which bits each table samples: enough bits for about 256 chance members a key, enough tables for recall."""
    k = max(8, (n >> 8).bit_length())
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** k))
    drawn = np.random.default_rng(k)
    return [drawn.choice(64 * words, k, replace=False) for _ in range(tables)]


def by_samples(nodes: DataFrame, tables: list[np.ndarray], words: int = LONG_WORDS) -> DataFrame:
    """(key, f0, f1, ...): each fingerprint under the sampled bits of every table."""
    names = ["key", *_columns(words)]
    schema = pa.schema([(n, pa.int64()) for n in names])
    picks, base = np.array(tables), 1 << len(tables[0])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = batch.slice(i, 2048)
                fps = np.stack([np.asarray(c) for c in b.columns], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
                own = (bits[:, picks].astype(np.int64) << np.arange(picks.shape[1])).sum(axis=2) + np.arange(len(picks)) * base
                yield emit(schema, {"key": own.reshape(-1)} | {f"f{w}": np.repeat(fps[:, w], len(picks)) for w in range(words)})

    return nodes.select(*_columns(words)).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances (rows: fingerprints, columns: pivots)."""
    return np.bitwise_count(fps[:, None, :] ^ PIVOTS[None, :, : fps.shape[1]]).sum(axis=2, dtype=np.int16)


def links_within(fps: np.ndarray, split: int | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links among distinct fingerprints (rows): index pairs joining every component of the link graph.

    With `split`, only pairs between fps[:split] and fps[split:] count (two tiles of one key).
    Members are sorted by their first pivot coordinate, so that each one meets only the window of
    members within `max_bits` of it; the other coordinates discard most of those before XOR.
    """
    n = len(fps)
    if n < 2 or split in (0, n):
        return []
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    side = None if split is None else order < split
    reach = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(n - 1):
        lo, hi = i + 1, int(reach[i])
        if hi <= lo:
            continue
        near = np.arange(lo, hi)
        if side is not None:
            near = near[side[lo:hi] != side[i]]
        for c in range(1, N_PIVOTS, 8):  # some coordinates at a time; few pairs survive the first ones
            if len(near) < 8:
                break
            near = near[(np.abs(table[near, c : c + 8] - table[i, c : c + 8]) <= max_bits).all(axis=1)]
        if len(near):
            near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(axis=1) <= max_bits]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                out.append((int(order[i]), int(order[j])))
    return out


def forest(fps: np.ndarray, side: np.ndarray | None, max_bits: int, degree: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs of rows within max_bits bits; with `side`, of pairs across it.

    `degree`, zeros, receives the number of such pairs of each row.
    """
    n, far = len(fps), 1 << 14
    best, origin, todo, out, at = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), [], 0
    for _ in range(n - 1):
        todo[at] = False
        d = np.bitwise_count(fps ^ fps[at]).sum(axis=1, dtype=np.int64)
        if side is not None:
            d[side == side[at]] = far
        if degree is not None:
            met = todo & (d <= max_bits)
            degree[met] += 1
            degree[at] += np.count_nonzero(met)
        nearer = todo & (d < best)
        best[nearer], origin[nearer] = d[nearer], at
        at = int(np.where(todo, best, far + 1).argmin())
        if best[at] <= max_bits:
            out.append((int(origin[at]), at))
    return out


def forests(fps: np.ndarray, begins: np.ndarray, ends: np.ndarray, max_bits: int, whole: int = 512):
    """(rows, links, degrees) of each group of rows with near pairs; groups of one size are compared at once.

    links are a forest's pairs of positions in `rows`, degrees as in `forest`.
    """
    sizes = ends - begins
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = begins[sizes == size]
        if size > whole:
            for lo in own.tolist():
                degree = np.zeros(size, np.int64)
                pairs = forest(fps[lo : lo + size], None, max_bits, degree)
                yield lo + np.arange(size), pairs, degree
            continue
        step = max(1, (1 << 21) // size**2)
        for k in range(0, len(own), step):
            lows = own[k : k + step]
            rows = fps[lows[:, None] + np.arange(size)]
            d = np.zeros((len(lows), size, size), np.int16)
            for w in range(fps.shape[1]):
                d += np.bitwise_count(rows[:, :, None, w] ^ rows[:, None, :, w])
            near = d <= max_bits
            near[:, np.arange(size), np.arange(size)] = False
            for g in np.flatnonzero(near.any(axis=(1, 2))).tolist():
                degree = near[g].sum(axis=1)
                some = np.flatnonzero(degree)
                yield lows[g] + some, forest(rows[g][some], None, max_bits), degree[some]


def tangled(pairs: list[tuple[int, int]], degree: np.ndarray) -> np.ndarray:
    """The first row of each row's component where it has more near pairs than forest links, else -1."""
    n = len(degree)
    if degree.sum() == 2 * len(pairs):
        return np.full(n, -1)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)
    first = np.array([find(x) for x in range(n)])
    spare = np.bincount(first, degree, n) > 2 * (np.bincount(first, minlength=n) - 1)
    return np.where(spare[first], first, -1)


def links(filed: DataFrame, max_bits: int, words: int = 1) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints filed under each key, as nodes.

    Links of one-word fingerprints span each component. Those of longer ones are a minimum spanning forest; further rows
    (a, b, part, key) then list the members a of each `tangled` component, named part, with b the side of a tile in a
    pair of tiles, else -1. Links have null for part and key.
    """
    own_columns = _columns(words)
    crowded = filed.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    crowded = stored(crowded, "simhash-crowded")
    if crowded.isEmpty():
        dealt = filed.select("key", F.lit(0).alias("tile"), F.lit(0).alias("other"), F.lit(0).alias("own"), *own_columns)
    else:
        t = F.coalesce("tiles", F.lit(1))
        own = filed.join(crowded, "key", "left").withColumn("own", F.when(t > 1, F.pmod(F.xxhash64(*own_columns), t)).otherwise(0).cast("int"))
        paired = own.withColumn("p", F.explode(F.sequence(F.lit(0), t - 1)))
        dealt = paired.select("key", F.least("own", "p").alias("tile"), F.greatest("own", "p").alias("other"), "own", *own_columns)
    parts = dealt.repartition("key", "tile", "other").sortWithinPartitions("key", "tile", "other", "own", *own_columns)  # ties of distance fall the same way each time
    names = ["a", "b"] if words == 1 else ["a", "b", "part", "key"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        held = None
        for b in batches:
            now = [np.asarray(c) for c in b.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            key, tile, other = now[:3]
            cut = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (other[1:] != other[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            if last:
                yield from found([x[:last] for x in now], cut)
            held = [x[last:] for x in now]  # the last group may go on in the next batch
        if held is not None and len(held[0]):
            yield from found(held, np.array([len(held[0])]))

    def found(rows, cut):
        key, tile, other, own = rows[:4]
        fps = np.stack([x.view(np.uint64) for x in rows[4:]], axis=1)
        begins = np.concatenate([[0], cut[:-1]])
        a, z = [], []
        crossed = tile[begins] != other[begins]
        if words > 1:
            yield from spanned(key, tile, other, own, fps, begins, cut, crossed)
        else:
            two = (cut - begins == 2) & ~crossed  # pairs, the most frequent groups, all at once
            at = begins[two]
            at = at[(np.abs(pivot_table(fps[at]) - pivot_table(fps[at + 1])) <= max_bits).all(axis=1)]
            at = at[np.bitwise_count(fps[at] ^ fps[at + 1]).sum(axis=1) <= max_bits]
            a += at.tolist()
            z += (at + 1).tolist()
            for lo, hi, cross in zip(begins.tolist(), cut.tolist(), crossed.tolist()):
                if not cross and hi - lo < 3:
                    continue
                split = int(np.searchsorted(own[lo:hi], other[lo])) if cross else None
                for i, j in links_within(fps[lo:hi], split, max_bits):
                    a.append(lo + i)
                    z.append(lo + j)
        if a:
            yield emit(schema, {"a": node_of(fps[a]), "b": node_of(fps[z])})

    def spanned(key, tile, other, own, fps, begins, cut, crossed):
        def across():
            for lo, hi in zip(begins[crossed].tolist(), cut[crossed].tolist()):
                degree = np.zeros(hi - lo, np.int64)
                pairs = forest(fps[lo:hi], own[lo:hi] == other[lo], max_bits, degree)
                yield np.arange(lo, hi), pairs, degree

        for some, side in ((forests(fps, begins[~crossed], cut[~crossed], max_bits), False), (across(), True)):
            a, z, member, part = [], [], [], []
            for at, pairs, degree in some:
                a += [int(at[i]) for i, _ in pairs]
                z += [int(at[j]) for _, j in pairs]
                first = tangled(pairs, degree)
                for f in np.unique(first[first >= 0]).tolist():
                    within = at[first == f]
                    name = xxhash.xxh64_intdigest(np.array([key[at[0]], tile[at[0]], other[at[0]], at[f] - at[0]], np.int64).tobytes(), SEED)
                    member += within.tolist()
                    part += [name] * len(within)
            if a:
                yield emit(schema, {"a": node_of(fps[a]), "b": node_of(fps[z]), "part": [None] * len(a), "key": [None] * len(a)})
            if member:
                b = (own[member] == other[member]).astype(np.int64) if side else np.full(len(member), -1)
                yield emit(schema, {"a": node_of(fps[member]), "b": b, "part": np.array(part, np.uint64).view(np.int64), "key": key[member]})

    return parts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge `(a, b)`.

    Large-star and small-star steps alternate; each round is written to the shared folder, so lineage stays
    short and no state reaches the driver but two counts. It ends at the fixed point: stars only.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "components")
    seen = None
    for _ in range(rounds):
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        *sums, most = degrees.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if sums == seen:
            break
        seen = sums
        # Where a hub has many neighbours, what is joined is written first: Spark splits a hub in a join of two shuffles,
        # but not above an aggregate.
        kept = (lambda df, name: stored(df, name)) if (most or 0) > HUB else (lambda df, name: df)
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low")
        big = kept(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components-big")
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = kept(big.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _lowest(marked: DataFrame) -> DataFrame:
    """(node, low): the smallest doc_id of each fingerprint; copies are combined before the shuffle."""
    return marked.groupBy("node").agg(F.min("doc_id").alias("low"))


def _classes(marked: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, component_id): the smallest doc_id of each fingerprint's component."""
    named = stored(_lowest(marked).join(tree, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "simhash-named")
    # Written first: Spark splits a large component in a join of two shuffles, but not above an aggregate.
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
    return stored(named.join(lowest, "root").select("node", "component_id"), "simhash-classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS, extra: int = EXTRA) -> DataFrame:
    """One row per input row: (doc_id, fingerprint hex string, component_id), linked at max_bits of 64 bits.

    component_id is the smallest non-null doc_id reachable over links, the row's own included. Null or
    wordless texts have fingerprint 0 and link like any other. Rows with a null doc_id keep their row, and
    take their class's smallest id (null where the class has none). Repeated ids give repeated rows.
    """
    marked = stored(fingerprints(df, id_col, text_col, shingle), "simhash")
    found = stored(links(by_blocks(marked.select("f0").distinct(), max_bits, extra), max_bits), "simhash-links")
    classes = _classes(marked, components(found))
    return marked.join(classes, "node").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """One row per input row: (doc_id, component_id), linked at a Jaccard similarity of distinct shingles.

    Null, empty and wordless texts are one class. Null and repeated ids as in `near_duplicates`.
    """
    marked, tree = _similar(df, id_col, text_col, shingle, similarity, recall)
    return marked.join(_classes(marked, tree), "node").select("doc_id", "component_id")


def _similar(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and (node, root) of those that have a link."""
    words = LONG_WORDS
    marked = stored(fingerprints(df, id_col, text_col, shingle, words), "simhash")
    nodes = stored(marked.select(*_columns(words)).distinct(), "simhash-nodes")
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    error = math.sqrt(differ * (1 - differ) / bits)
    # A pair just at the threshold is within 2.5 standard errors of the expected number of bits; the tables are made
    # for one that lies a standard error off.
    max_bits = round(bits * (differ + 2.5 * error))
    tables = bit_tables(nodes.count(), differ + error, words, recall)
    met = stored(links(by_samples(nodes, tables, words), max_bits, words), "simhash-met")
    near = stored(met.where("part is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-near")
    sets = _sets(df, marked, near, id_col, text_col, shingle)
    tree = components(stored(verified(near, sets, similarity), "simhash-links"))
    members = met.where("part is not null").select("part", "key", F.col("a").alias("node"), F.col("b").alias("side"))
    more = stored(crossing(members, tree, sets, tables, max_bits, similarity), "simhash-crossing")
    if not more.isEmpty():
        tree = components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    return marked, tree


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashed word shingles of a text, sorted; none without words."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    parts = (b" ".join(own[i : i + shingle]) for i in range(max(1, len(own) - shingle + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def _sets(df: DataFrame, marked: DataFrame, near: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, set binary, f0, f1, ...) of the fingerprints that have a link to verify, from one text of each."""
    linked = near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct()
    # The texts meet their fingerprints again by id and hash; nodes are computed once more from the few that come through.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one")
    rows = marked.groupBy("node").agg(one).join(linked, "node", "left_semi").select(F.col("one.doc_id").alias("id"), F.col("one.h").alias("own")).distinct()
    some = texts(df, id_col, text_col)
    some = some.join(rows.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash(F.col("text")) == F.col("own")), "left_semi")
    names = _columns(LONG_WORDS)
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary()), *((n, pa.int64()) for n in names)])

    def run(batches):
        for b in slices(batches):
            own = [t or b"" for t in b.column(1).to_pylist()]
            fps = np.array([fingerprint(t, shingle, LONG_WORDS) for t in own], dtype=np.uint64).reshape(-1, LONG_WORDS)
            yield emit(schema, {"node": node_of(fps), "set": [shingles(t, shingle).tobytes() for t in own]} | {n: np.ascontiguousarray(fps[:, i]).view(np.int64) for i, n in enumerate(names)})

    return stored(some.mapInArrow(run, "node long, set binary, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["node"]), "simhash-sets")


def verified(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have at least this Jaccard similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    first = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    def run(batches):
        for batch in batches:
            a, z = [], []
            for p, q, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                if both >= similarity * (len(u) + len(v) - both):
                    a.append(p)
                    z.append(q)
            if a:
                yield emit(schema, {"a": a, "b": z})

    return near.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def joining(fps: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, filed: np.ndarray, max_bits: int, similarity: float, step: int = 256) -> list[tuple[int, int]]:
    """Pairs of rows at this Jaccard similarity that join the components `comp` (changed in place).

    Tested are the pairs within max_bits bits, of two components, on two sides (-1: no sides), that share none of `filed`'s
    columns: such a pair is tested under that key.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    flag, out = np.zeros(len(terms), bool), []
    for i in range(len(fps) - 1):
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1) <= max_bits]
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i])]
        j = j[~(filed[j] == filed[i]).any(axis=1)]
        if not len(j):
            continue
        flag[own[i]] = True
        for k in range(0, len(j), step):
            some = j[k : k + step]
            some = some[comp[some] != comp[i]]
            if not len(some):
                continue
            both = np.add.reduceat(flag[np.concatenate([own[x] for x in some.tolist()])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for x in some[both >= similarity * (sizes[some] + sizes[i] - both)].tolist():
                if comp[x] != comp[i]:
                    out.append((i, x))
                    comp[comp == comp[x]] = comp[i]
        flag[own[i]] = False
    return out


def crossing(members: DataFrame, tree: DataFrame, sets: DataFrame, tables: list[np.ndarray], max_bits: int, similarity: float) -> DataFrame:
    """(a, b): verified links between the components of `tree` among the members (part, key, node, side) of each part."""
    rooted = members.join(tree, "node", "left").select("part", "key", "node", "side", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("part")
    left = stored(rooted.join(mixed, "part", "left_semi"), "simhash-mixed")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    base, picks, names = 1 << len(tables[0]), np.array(tables), _columns(LONG_WORDS)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        column = lambda n: part.column(n).to_numpy()
        node, key = column("node"), column("key")
        fps = np.stack([column(n).view(np.uint64) for n in names], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        before = picks[: int(key[0]) // base]
        filed = (bits[:, before].astype(np.int64) << np.arange(picks.shape[1])).sum(axis=2)
        own = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
        pairs = joining(fps, own, column("root").copy(), column("side"), filed, max_bits, similarity)
        return pa.table({"a": node[[i for i, _ in pairs]], "b": node[[j for _, j in pairs]]} if pairs else {"a": [], "b": []}, schema=schema)

    return left.join(sets, "node").groupBy("part").applyInArrow(run, "a long, b long")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df's rows, with all their columns: one of each class stays, the one with the smallest id.

    Classes are those of `similar`. A null id comes after all others; where the smallest id is repeated within a class,
    its row with the smallest text stays (null: empty).
    """
    marked, tree = _similar(df, id_col, text_col, shingle, similarity, RECALL)
    named = stored(_lowest(marked).join(tree, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "simhash-named")
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("least")), "simhash-lowest")
    first = stored(named.join(lowest, "root").where("low <=> least").select("node", "root", "low"), "simhash-first")
    # Copies of a row share its id and hash, and so its class: each (id, h) has one root.
    kept = marked.join(first, "node").where("doc_id <=> low").groupBy("root", F.col("doc_id").alias("kept"), "h").count()
    kept = stored(kept, "simhash-kept")
    several = stored(kept.groupBy("root").agg(F.sum("count").alias("n")).where("n > 1").select("root"), "simhash-several")
    plain, own, text = numbered(df), f"c{position(df, id_col)}", f"c{position(df, text_col)}"
    same = F.col(own).eqNullSafe(F.col("kept")) & (text_hash(F.col(text)) == F.col("h"))
    # A merge join at every size: as many ids as documents stay, so this side is never one to broadcast.
    rows = plain.join(kept.join(several, "root", "left_anti").hint("merge"), same, "left_semi")
    if not several.isEmpty():
        rest = plain.join(kept.join(several, "root", "left_semi"), same)
        best = rest.groupBy("root").agg(F.min_by(F.struct(*plain.columns), F.coalesce(text, F.lit(""))).alias("r"))
        rows = rows.unionByName(best.select("r.*"))
    return rows.toDF(*df.columns)
