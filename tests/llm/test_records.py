"""Chat formatting and WARC transactions."""

import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import chat, warc
from palimpsest.llm.common import shared_dir

TEXT = st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "\n", "s>", "<", "[", "é🎉", "INST]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=6))
def test_rendering_reads_back(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    assert [chat.unescape(text[a : a + n]) for a, n in spans] == [t for r, t in messages if r == "assistant"]
    for _, t in messages:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_broken_conversations_are_refused():
    good, _ = chat.render([("user", "hi")])
    for bad in (good[:-1], "x" + good, good + "tail"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def plain_fold(events):
    out = []
    for kind, role, text in events:
        text = text or ""
        if kind == "message":
            out.append([role or "", text])
        elif kind == "delete":
            out = out[:-1]
            continue
        elif kind in ("delta", "edit"):
            if not out:
                out.append([role or "", ""])
                out[-1][1] = ""
            out[-1][1] = out[-1][1] + text if kind == "delta" else text
        elif kind == "regenerate" and out:
            out[-1][1] = ""
        if out and not out[-1][0] and role:
            out[-1][0] = role
    return [tuple(x) for x in out]


KINDS = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "unknown"]


def test_event_logs_fold_to_messages(spark):
    rng = random.Random(4)
    log = [(c, m, s, rng.choice(KINDS), rng.choice(["user", "assistant", None]), rng.choice(["x", "y</s>", "", None, "long " * 50])) for c in (None, 1, 2, 3) for m in (None, 0, 1, 2) for s in range(9) if rng.random() < 0.8]
    # one conversation holds most events, over many ranges
    log += [(9, m, s, "delta", "assistant" if m % 2 else "user", f"{m}.{s} ") for m in range(400) for s in range(3)]
    shuffled = log[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, chat.EVENT).repartition(4)
    found = {r.conv_id: (r.n_turns, chat.parse(r.formatted), r.loss, r.formatted) for r in chat.conversations(df).collect()}
    none = lambda x: (x is not None, x if x is not None else 0)
    expected = {}
    for c, m in sorted({(e[0], e[1]) for e in log}, key=lambda k: (none(k[0]), none(k[1]))):
        events = sorted((e for e in log if e[:2] == (c, m)), key=lambda e: e[2])
        expected.setdefault(c, []).extend(plain_fold([e[3:] for e in events]))
    expected = {c: m for c, m in expected.items() if m}
    assert {c: v[1] for c, v in found.items()} == expected and all(v[0] == len(v[1]) for v in found.values())
    for n, turns, loss, text in found.values():
        assert [chat.unescape(text[s.start : s.start + s.length]) for s in loss] == [t for r, t in turns if r == "assistant"]


def test_conversation_rows_with_nulls_ties_and_repeats(spark, clashing):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, None, "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", "long " * 40_000)]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat.digests(chat.conversations(chat.events_of(turns))).collect()}
    assert found[1].n_turns == 4 and found[None].n_turns == 1 and found[2].loss_chars == 200_000
    sha = hashlib.sha256("\nfirst\nuser\n\nassistant\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n".encode()).hexdigest()
    assert found[1].turns_sha256 == sha and found[1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]" * 2).hexdigest()
    assert chat.digests(chat.conversations(chat.events_of(turns.where("false")))).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_captures_round_trip_and_revisit(spark, clashing):
    long = "line\r\n\r\nWARC/1.1\r\n\r\n" * 20_000
    rows = [(4, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (5, "http://c/", None), (1, "http://d/", ""), (7, "http://e/", long), (8, "http://f/", "é🎉"), (None, "http://g/", "same"), (3, "u", "x"), (3, "u", "x")]
    path = shared_dir(spark, "warc-test")
    warc.write(warc.captures(clashing(pages_of(spark, rows))), path)
    nested = warc.transactions(warc.read(spark, path)).collect()
    assert len(nested) == len(rows)
    found = sorted((r.capture_id.split(":")[0], r.response.record_type, (r.response.refers_to or "").split(":")[0], r.response.payload_bytes, r.response.computed_digest or r.response.payload_digest) for r in nested)
    first = {"same": "2", "": "1", "x": "3", long: "7", "é🎉": "8"}
    expected = []
    for i, _, html in rows:
        p = html or ""
        digest = base64.b32encode(hashlib.sha1(p.encode()).digest()).decode()
        own = str(i) if i is not None else ""
        again = first[p] != own or (own == "3" and ("3", "response", "", 1, digest) in expected)
        expected.append((own, "revisit" if again else "response", first[p] if again else "", len(p.encode()), digest))
    assert found == sorted(expected)
    body = next(r for r in nested if r.capture_id.startswith("7:"))
    assert body.response.block.endswith(long) and body.response.computed_digest == body.response.payload_digest
    assert all(r.request and r.metadata for r in nested) and body.request.block.startswith("GET http://e/ HTTP/1.1")
    assert next(r for r in nested if r.capture_id.startswith("2:")).target_uri == "http://b/%0A%0AX: y"


def test_small_payloads_and_empty_tables(spark):
    rows = pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    found = {r.page_id: r.refers_to for r in warc.captures(rows, least_bytes=3).collect()}
    assert found[1] is found[2] is found[3] is None and found[4].startswith("3:")
    path = shared_dir(spark, "warc-empty")
    warc.write(warc.captures(rows.where("false")), path)
    assert warc.transactions(warc.read(spark, path)).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(kind, own, block, **more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    response = record("response", 1, b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Target_URI="http://x/")
    alone = record("metadata", 3, b"m: 1\r\n", WARC_Concurrent_To="<urn:uuid:77>")
    (tmp_path / "a.warc.gz").write_bytes(response + record("request", 2, b"GET /", WARC_Concurrent_To="<urn:uuid:1>") + alone)
    found = {r.capture_id: r for r in warc.transactions(warc.read(spark, str(tmp_path))).collect()}
    assert found["urn:uuid:1"].response.payload_bytes == 4 and found["urn:uuid:1"].request.block == "GET /"
    assert found["urn:uuid:77"].response is None and found["urn:uuid:77"].metadata.block == "m: 1\r\n"
    with pytest.raises(ValueError):
        list(warc.records(response[: len(response) // 2] + gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab")))


def test_large_payloads_bound_the_files_of_archives(spark, monkeypatch):
    """A third of the rows share one payload; sizes lie in several classes."""
    import glob

    monkeypatch.setattr(warc, "CLASSES", (20, 200))
    monkeypatch.setattr(warc, "FILE_BYTES", 60)
    rows = [(i, "u", "popular" * 20 if i % 3 == 0 else f"{i}" * (1 + 40 * (i % 7))) for i in range(60)]
    path = shared_dir(spark, "warc-sizes")
    warc.write(warc.captures(pages_of(spark, rows)), path)
    nested = warc.transactions(warc.read(spark, path)).collect()
    found = {int(r.capture_id.split(":")[0]): r.response for r in nested}
    assert {i: r.payload_bytes for i, r in found.items()} == {i: len(t) for i, _, t in rows}
    assert all((r.record_type == "revisit") == (i % 3 == 0 and i > 0) and (r.refers_to or "0:").startswith("0:") for i, r in found.items())
    for f in glob.glob(path + "/*.gz"):
        own = [int(h["content-length"]) for h, _ in warc.records(open(f, "rb").read()) if h["warc-type"] in ("response", "revisit")]
        assert len(own) <= 3


def test_payloads_do_not_meet_by_digest(spark, sf_dir):
    """The join by digest has narrow rows on both sides; payloads join by capture."""
    plan = warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert len(joins) == 2 and "capture" in joins[0] and "payload_digest" in joins[1] and "Aggregate" not in plan
    narrow = plan[plan.index(joins[1]) :]
    assert "payload#" not in narrow.split("payload_digest", 1)[1].replace("payload_digest", "").split("Relation")[0]
