"""Token counts, byte-level BPE and packing, against the public tokenizer libraries."""

import base64
import hashlib
import os
import random
import zlib

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import bytebpe, packing, tokencount

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LETTERS = "abcdefghijklmnoprstuvwyz'    <>|.,!?0123ÉéßñÑ日\n\t🎉Σ_-ẞ\u0301"


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(WORDS)


def test_counts_equal_the_library(counter, oddities):
    library = Tokenizer.from_file(WORDS)
    texts = noise(1500) + [t or "" for _, t, _ in oddities]
    assert counter.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_table_starts_over(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "MOST", 50)
    texts = noise(60, 2)
    library = Tokenizer.from_file(WORDS)
    small = tokencount.Counter(WORDS)
    for t in texts:
        assert small.counts([t])[0] == len(library.encode(t, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=200), st.integers(1, 40))
def test_chunk_maps_compose(classes, chunk):
    """Marks by chunks and prefix scan equal those of one machine that reads straight on."""
    classes = np.array([*classes, tokencount.SPACE], np.uint8)
    to, mark = tokencount.pretoken_tables()
    state, starts = tokencount.BETWEEN, set()
    for i, c in enumerate(classes):
        key = int(c) * tokencount.N_STATES + state
        starts |= {i} if mark[key] & tokencount.HERE else set()
        starts |= {i - 1} if mark[key] & tokencount.BEFORE else set()
        state = int(to[key])
    assert tokencount.pretoken_starts(classes, chunk).tolist() == sorted(starts)


def test_count_operator(docs, oddities, clashing):
    library = Tokenizer.from_file(WORDS)
    expected = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t, _ in oddities)
    rows = tokencount.token_counts(clashing(docs(oddities)), WORDS, 5).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == expected
    assert tokencount.token_counts(docs([]), WORDS, 5).count() == 0


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        tokencount.Counter(BYTES)
    with pytest.raises(ValueError):
        packing.Encoder(WORDS)


def stitched(codec, text, chunk, overlap):
    """What the tasks do, one after the other: None where two chunks have no common boundary."""
    n = len(text)
    begins = range(0, max(1, -(-(n - overlap) // chunk)) * chunk, chunk)
    return bytebpe.joined([codec.encode_chunk(text[b : b + chunk + overlap], chunk, overlap, b + chunk + overlap >= n) for b in begins], chunk)


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library_of_ranks():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=300), st.integers(1, 20), st.integers(1, 20))
def test_chunks_stitch_to_the_whole(codec, library_of_ranks, text, chunk, overlap):
    expected = np.array(library_of_ranks.encode_ordinary(text), "<u4").tobytes()
    assert codec.encode(text) == expected
    assert stitched(codec, text, chunk, overlap) in (expected, None)


def test_most_chunks_stitch(codec):
    texts = [" ".join(noise(40, i)) for i in range(20)]
    assert all(stitched(codec, t, 100, 60) == codec.encode(t) for t in texts)


CONTEXTS = ["{}'s", "1{}2", " {} x", "e{}\u0301", "e\u0316{}\u0301x", "Σ{}{}'ll"]


@pytest.mark.parametrize("context", CONTEXTS)
def test_every_code_point_as_the_libraries_have_it(counter, codec, library_of_ranks, context):
    """All assigned code points, and of those that no library knows every 97th."""
    import unicodedata

    from palimpsest.llm import libraryclasses

    known = (libraryclasses.classes("regex") != libraryclasses.OTHER) | (libraryclasses.classes("tokenizers") != libraryclasses.OTHER)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i % 97 == 0 or (known[i] and i % 7 == 0) or unicodedata.category(chr(i)) not in ("Cn", "Co", "Lo"))]
    texts = [context.format(chr(i), chr(i)) for i in points]
    words, plain, own = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    assert counter.counts(texts).tolist() == [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]
    assert [own.ids(t).tolist() for t in texts] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts] == library_of_ranks.encode_ordinary_batch(texts)


def test_random_texts_of_all_planes(counter, codec, library_of_ranks):
    rng = random.Random(8)
    some = [*range(32, 127)] * 30 + [rng.randrange(0x110000) for _ in range(3000)] + [0x300 + i for i in range(112)] * 5
    texts = ["".join(chr(c) for c in rng.choices(some, k=rng.randrange(1, 40)) if not 0xD800 <= c < 0xE000) for _ in range(6000)]
    words, plain, own = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    assert counter.counts(texts).tolist() == [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]
    assert [own.ids(t).tolist() for t in texts] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts] == library_of_ranks.encode_ordinary_batch(texts)


def test_pieces_of_long_texts_are_normalised_alike(counter, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(tokencount, "PIECE", 20)
    texts = ["".join(random.Random(i).choices("aé e\u0301\u0316\u1ac3Σİ \n\U0003d0a3", k=300)) for i in range(50)] + ["e\u0301" * 200]
    assert counter.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 40), (5, 1)])
def test_chunks_of_long_texts_are_tasks_of_their_own(docs, library_of_ranks, clashing, chunk, overlap):
    """(5, 1): hardly a pair of chunks has a common boundary, so whole texts are encoded instead."""
    rows = [(i, " ".join(noise(12, 50 + i)), None) for i in range(8)]
    rows += [(90, "x" * 500, None), (91, "  \n" * 200, None), (92, "é'll \U0003d0a3's " * 40, None), rows[0], rows[0], (93, rows[1][1], None), (None, rows[1][1], None), (94, "short", None), (95, None, None), (95, "", None)]
    found = bytebpe.digests(clashing(docs(rows)), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    expected = []
    for i, t, _ in rows:
        ids = np.array(library_of_ranks.encode_ordinary(t or ""), "<u4")
        expected.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted(expected)


def test_byte_bpe_equals_the_library(docs, oddities, clashing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = oddities + [(100 + i, t, None) for i, t in enumerate(noise(200, 3))]
    found = bytebpe.digests(clashing(docs(rows)), RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        expected.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted(expected)
    coded = bytebpe.decode(bytebpe.encode(docs(rows), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in coded.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bytebpe.digests(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packed_ids_equal_the_library(oddities):
    library, own = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    texts = noise(400, 4) + [t or "" for _, t, _ in oddities]
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.ids(t).tolist() for t in texts] == expected
    own.unlike[:] = True  # the path for texts that the two engines cut differently
    own.unlike[:128] = False
    assert [own.ids(t).tolist() for t in texts] == expected


def plain_best_fit(counts, capacity):
    """Sequences that best fit opens for one document after another, longest first."""
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            best = capacity
        else:
            gaps.remove(best)
        gaps.append(best - n)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 60), max_size=30))
def test_sweeps_place_every_rank_once_without_gaps(counts):
    plan, opened = packing.sweep(counts, 64)
    fill, ranks = {}, {}
    for length, lo, hi, first, offset in plan:
        for k in range(hi - lo):
            ranks.setdefault(length, []).append(lo + k)
            fill.setdefault(first + k, []).append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    assert sorted(fill) == list(range(opened))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    # Any packing that opens only when nothing fits, longest first, stays within 5/4 of the best (and of best fit).
    assert 4 * opened <= 5 * plain_best_fit(counts, 64) + 4


def test_packing_operator(docs, oddities, clashing):
    library = Tokenizer.from_file(BYTES)
    rows = [(i, t, k) for i, t, k in oddities if i not in (3, None)] + [(500 + i, t * 7, None) for i, t in enumerate(noise(120, 5))]
    packed = packing.pack(clashing(docs(rows)), BYTES, end_id=2, capacity=128, keep_ids=True)
    found = packed.collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for r in found:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.ids == own
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, own))
    for i, whole in ids.items():
        parts = sorted(by_doc[i])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == len(whole)
        assert all(n == 128 for _, _, n in parts[1:]) and (len(whole) > 128) == (len(parts) > 1)
    whole = {r.sequence_id: r.tokens for r in packing.sequences(packed).collect()}
    for s, parts in by_sequence.items():
        tokens = [t for _, _, own in sorted(parts) for t in own]
        assert whole[s] == tokens and len(tokens) <= 128
    least = -(-sum(map(len, ids.values())) // 128)
    assert len(by_sequence) <= least * 1.05 + 1
    assert packing.pack(docs([]), BYTES, end_id=2).count() == 0
    assert packing.pack(docs([(3, "a", None)] * 3 + [(None, None, None)]), BYTES, end_id=2).count() == 4
