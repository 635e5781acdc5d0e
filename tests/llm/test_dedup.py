"""SimHash classes against brute force, and the pipeline."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    parts = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def families():
    rng = random.Random(7)
    rows = []
    for f in range(6):
        words = [f"f{f}w{rng.randrange(400)}" for _ in range(300)]
        rows += [edited(rng, words, k % 4) for k in range(12)] + [edited(rng, words, 25)]
    rows += [edited(rng, [f"s{i}{rng.randrange(900)}" for _ in range(80)], 0) for i in range(40)]
    rng.shuffle(rows)
    return [(i, t, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tile", [4096, 5])
def test_classes_equal_brute_force(docs, families, oddities, clashing, monkeypatch, tile):
    """Also with tiny tiles, so that crowded keys are cut and every pair of tiles meets."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = families + [(1000 + (i or 0), t, k) for i, t, k in oddities if len(t or "") < 10_000]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    roots = groups(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    low = {}
    for (i, *_), r in zip(rows, roots):
        low[r] = min(i, low.get(r, i))
    expected = sorted((i, f"{fp:016x}", low[r]) for (i, *_), fp, r in zip(rows, fps, roots))
    found = simhash.near_duplicates(clashing(docs(rows))).collect()
    assert sorted(tuple(r) for r in found) == expected


def test_empty_null_and_repeated(docs):
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.similar(docs([])).count() == 0
    rows = simhash.near_duplicates(docs([(5, None, None), (4, " \n", None), (None, "", None), (9, "x y z w v", None), (9, "x y z w v", None)])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("4", 4), ("5", 4), ("9", 9), ("9", 9), ("None", 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 63), max_size=6), min_size=2, max_size=40), st.data())
def test_links_within_span_the_components(bases, flips, data):
    fps = np.array(sorted({bases[i % len(bases)] ^ sum(1 << b for b in set(f)) for i, f in enumerate(flips)}), np.uint64)[:, None]
    split = data.draw(st.one_of(st.none(), st.integers(1, max(1, len(fps) - 1))))
    near = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b])[0]) <= 4 and (split is None or (a < split) != (b < split))
    expected = groups(len(fps), near)
    for found in (simhash.links_within(fps, split, 4), simhash.forest(fps, None if split is None else np.arange(len(fps)) < split, 4)):
        assert all(near(a, b) for a, b in found) and len(found) <= len(fps) - 1
        pairs = {tuple(sorted(p)) for p in found}
        assert groups(len(fps), lambda a, b: (a, b) in pairs) == expected
    assert all(any((int(fps[a][0]) ^ int(fps[b][0])) & m == 0 for m in simhash.block_masks()) for a in range(len(fps)) for b in range(a) if int(np.bitwise_count(fps[a] ^ fps[b])[0]) <= 4)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, (300, 1), dtype=np.uint64)
    table = simhash.pivot_table(fps)
    for _ in range(2000):
        a, b = rng.integers(0, 300, 2)
        assert np.abs(table[a] - table[b]).max() <= np.bitwise_count(fps[a] ^ fps[b])[0]


def jaccard(a, b):
    x, y = (set(simhash.shingles((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("tile", [4096, 4])
def test_similar_texts_share_a_class(docs, families, clashing, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = [t for _, t, _ in families]
    expected = groups(len(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    found = {r.doc_id: r.component_id for r in simhash.similar(clashing(docs(families))).collect()}
    assert [found[i] for i in range(len(texts))] == expected
    kept = simhash.deduplicated(clashing(docs(families))).collect()
    assert sorted(r[0] for r in kept) == sorted(set(expected)) and len(kept[0]) == 16


@pytest.mark.parametrize("tile", [4096, 64])
def test_links_of_a_family_below_the_threshold(docs, monkeypatch, tile):
    """Most pairs are near 0.75: a forest of bit distances skips many of the few links at 0.8."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [edited(rng, words, rng.randrange(4, 7)) for _ in range(240)]
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for t in texts]
    fps = np.array([simhash.fingerprint(t.encode(), 5, 4) for t in texts])
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    differ = np.arccos(1.6 / 1.8) / np.pi
    error = (differ * (1 - differ) / 256) ** 0.5
    tables = simhash.bit_tables(len({f.tobytes() for f in fps}), differ + error)
    meet = np.array([(bits[:, None, t] == bits[None, :, t]).all(axis=2) for t in tables]).any(axis=0)
    meet &= (bits[:, None, :] != bits[None, :, :]).sum(axis=2) <= round(256 * (differ + 2.5 * error))
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    expected = groups(len(texts), lambda a, b: meet[a, b] and alike(a, b))
    assert 1 < len(set(expected)) < len(texts)
    found = {r.doc_id: r.component_id for r in simhash.similar(docs([(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_deduplicated_odd_rows(docs, oddities):
    rows = docs([*oddities, (3, "a", "en")])
    kept = simhash.deduplicated(rows).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) == 1 and ids.count(0) == 1 and not {1, 2, 40} & set(ids) and ids.count(None) == 1
    assert simhash.deduplicated(docs([])).count() == 0


def test_deduplicated_keeps_one_row_of_each_class(docs):
    """Ids that name several texts, or none: rows are chosen by their class."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(7, a, None), (7, b, None), (8, b, None), (9, c, None), (3, d, None), (9, d + " more", None), (None, a, None), (None, "x y", None), (None, "x y", None), (7, a, None), (10, "x y", None), (None, "p q", None), (None, "p q", None)]
    rows += [(None, " ".join(f"e{i}" for i in range(60)) + end, None) for end in (" more", "")]
    kept = simhash.deduplicated(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("7", a), ("7", b), ("9", c), ("3", d), ("10", "x y"), ("None", "p q"), ("None", rows[-1][1])])


@pytest.mark.parametrize("hub", [1 << 20, 3])
def test_components_of_long_chains_and_stars(spark, monkeypatch, hub):
    """Also with what is joined written first, as for large hubs."""
    monkeypatch.setattr(simhash, "HUB", hub)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, None)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "a long, b long")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(r == 0 for n, r in found.items() if n <= 300) and all(r == 1000 for n, r in found.items() if 1000 < n < 2000)
    assert simhash.components(df.where("false")).count() == 0


def test_pipeline_against_its_parts(spark, sf_dir):
    """Each stage alone, by plain code, over what the stage before it kept."""
    import corpus_pipeline
    from palimpsest.llm import langid, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_dedup", "pack"]
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = {i for i, t in texts.items() if not model.predict([t.encode()])[2][0]}
    assert {r.doc_id for r in kept.collect()} == expected and len(expected) > 0.95 * len(texts)
    better = stages["quality_rules"](spark, kept, sf_dir)
    expected = {r.doc_id for r in quality.judged(kept).where("kept").collect()}
    assert {r.doc_id for r in better.collect()} == expected
    ids = sorted(expected)
    roots = groups(len(ids), lambda a, b: jaccard(texts[ids[a]], texts[ids[b]]) >= 0.8)
    single = stages["near_dedup"](spark, better, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted({ids[r] for r in roots})
    packed = stages["pack"](spark, single, sf_dir).select("doc_id").distinct()
    assert {r.doc_id for r in packed.collect()} == {ids[r] for r in roots}
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == packed.count()
