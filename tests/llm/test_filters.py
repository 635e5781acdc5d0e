"""Language ID, quality rules and URL filters."""

import base64
import math
import random
import re
import zlib

import pytest

from palimpsest.llm import langid, quality, urlfilter
from palimpsest.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then it rests", "de": "der schnelle braune fuchs springt über den faulen hund und ruht sich aus", "ru": "быстрая коричневая лиса прыгает через ленивую собаку и отдыхает"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(name, QUERIES[name], ORACLE_SQL[name])


@pytest.fixture(scope="module")
def corpus(docs):
    return docs([(i, " ".join(SAMPLES[lang].split()[i % 5 :]), lang) for i, lang in enumerate(list(SAMPLES) * 60)])


@pytest.fixture(scope="module")
def model(corpus):
    return langid.fit(corpus)


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in rows.select("doc_id", "lang").collect()}
    found = langid.predict(rows, langid.fit(rows)).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_on_odd_texts(docs, oddities, clashing, model):
    rows = {str(r.doc_id): r for r in langid.predict(clashing(docs(oddities)), model).collect()}
    lettered = {str(i): t is not None and any(c.isalpha() for c in t) for i, t, _ in oddities}
    for i, r in rows.items():
        assert (r.lang_pred == "und") == (not lettered[i]) and (r.lang_pred in {*SAMPLES, "und"})
        assert r.rejected or lettered[i]
    assert rows["None"].held_out
    assert langid.predict(docs([]), model).count() == 0
    kept = langid.accepted(clashing(docs([(1, SAMPLES["de"], None), (2, "123", None), (3, None, None)])), model)
    assert [r[0] for r in kept.collect()] == [1] and len(kept.columns) == 16


def plain_vector(text, idf):
    """TF-IDF over hashed byte trigrams, one at a time."""
    fold = {**{b: 32 for b in range(128)}, **{b: b for b in range(97, 123)}, **{b: b + 32 for b in range(65, 91)}, **{b: b for b in range(128, 256)}}
    folded = [32, *(fold[b] for b in text.encode()), 32]
    tf = {}
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        if (a, b, c) != (32, 32, 32):
            k = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 19
            tf[k] = tf.get(k, 0) + 1
    v = {k: (1 + math.log(n)) * float(idf[k]) for k, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()}


def test_predictions_against_plain_code(spark, sf_dir, docs, oddities):
    """Every document of a table, and odd ones, by the rule written out; the weights by counting documents."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(table, max_train=10**6)
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    train = [t for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None]
    sizes = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None:
            sizes[lang] = sizes.get(lang, 0) + 1
    flat = [1.0] * langid.BUCKETS
    found = {}
    for t in train:
        for k in plain_vector(t, flat):
            found[k] = found.get(k, 0) + 1
    assert all(abs(model.idf[k] - (math.log((1 + len(train)) / (1 + n)) + 1)) < 1e-4 for k, n in found.items())
    assert set(model.langs) == set(sizes) and len(model.langs) <= 4 * len(sizes)
    odd = [(10**6 + k, t, None) for k, (_, t, _) in enumerate(oddities) if len(t or "") < 20_000]
    out = {r.doc_id: r for r in langid.predict(docs([(i, t, lang) for i, t, lang in rows] + odd), model).collect()}
    for i, t, _ in rows + odd:
        if t is None or not any(c.isalpha() for c in t):
            assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
            continue
        v = plain_vector(t, model.idf)
        near = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(near)
        assert abs(out[i].score - min(1.0, max(0.0, best))) < 1e-4
        k = model.langs.index(out[i].lang_pred)
        assert max(n for n, lang in zip(near, model.langs) if lang == out[i].lang_pred) > best - 1e-4
        assert out[i].rejected == (out[i].score < model.floors[k]) or abs(best - model.floors[k]) < 1e-4


def test_what_is_no_language_of_the_model_goes(spark):
    """One odd labelled text doesn't set the floor; texts of other kinds are rejected, and few others."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(4 * k, "Zq.", "en") for k in range(10**6, 10**6 + 2)], "doc_id long, text string, lang string")
    model = langid.fit(table.select("doc_id", "text", "lang").unionByName(odd), max_train=10**6)
    rng = random.Random(1)
    strange = [base64.b64encode(rng.randbytes(900)), "To jest zwykły polski tekst o pogodzie i przyrodzie".encode(), "这是一个测试文本，关于天气。".encode(), "Это простой русский текст о погоде".encode()]
    assert model.predict(strange)[2].all()
    rows = langid.predict(table, model).where("lang_pred <> 'und'")
    assert rows.where("rejected").count() <= 0.005 * rows.count()


def test_a_model_of_nothing_rejects_everything(docs):
    empty = langid.fit(docs([(1, None, "en"), (None, "text", "en"), (5, "text", None)]))
    assert [r.lang_pred for r in langid.predict(docs([(1, "text", None)]), empty).collect()] == ["und"]
    assert langid.accepted(docs([(1, "text", None)]), empty).count() == 0


def test_training_is_bounded_and_repeatable(corpus, model):
    small = langid.fit(corpus, max_train=9)
    assert set(small.langs) <= set(SAMPLES) and len(small.langs) <= 9
    assert (langid.fit(corpus).centroids == model.centroids).all()


def plain_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_metrics_against_plain_code(docs, oddities, clashing):
    texts = oddities + [(60 + n, " ".join(f"w{i * i % n}" for i in range(90)), None) for n in range(2, 40)] + [(200, "a b c d e f g h " * 3 + "i", None), (201, "a b c d e f g h x a b c d e f g h", None)]
    rows = quality.judged(clashing(docs(texts))).collect()
    found = sorted((str(r.doc_id), *r[1:6]) for r in rows)
    assert found == sorted((str(i), *plain_metrics(t)) for i, t, _ in texts)
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality.judged(docs([])).count() == 0


def test_the_order_of_rules_changes_no_verdict(docs, oddities):
    good = " ".join(f"word{i}" for i in range(60))
    rows = docs([*oddities, (70, good, None), (71, good + " #" * 30, None), (72, good + "\nline" * 30, None), (73, good, None)])
    by_query = sorted(r.doc_id for r in quality.judged(rows).where("kept").collect())
    rules = (*quality.BASE, *quality.MORE)
    for order in (rules, rules[::-1], None):
        assert sorted(r.doc_id for r in quality.accepted(rows, order).collect()) == by_query
    assert {70, 73} <= set(by_query) and not {71, 72} & set(by_query)


def test_profile_ranks_by_rejection_per_cost(docs):
    rows = docs([(i, "too short", None) for i in range(30)])
    ranked = quality.profile(rows)
    rates = [(share + 1e-6) / s for _, s, share in ranked]
    assert rates == sorted(rates, reverse=True) and {r.name: share for r, _, share in ranked}["short"] == 1


def test_native_plans_have_no_python(spark, sf_dir):
    for name in ("op4_url_filters", "op10_quality_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme/net/": ("", "", None), "http://": ("", "", None),
    "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "x://example.net/de/": ("example.net", "/de/", "net/"),
    "http://net/": ("net", "/", "net/"), "http://net": ("net", "", None), "http://xnet/": ("xnet", "/", None), "http://a.org/fr/?x=://b/c": ("a.org", "/fr/", "org/fr/"),
    "http://example.com/de/1\n2": ("example.com", "/de/1\n2", "example.com/de/"), "http://ÄB.com#/x": ("Äb.com", "", None), "http://h?/p": ("h", "", None),
}


def test_hosts_paths_and_fixed_rules(spark, clashing):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://net/", None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in urlfilter.judge(clashing(pages), labels, URL_RULES).collect()}
    verdicts = {"net/": "block", "example.com/de/": "block"}
    for i, expected in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == expected and rows[i].verdict == verdicts.get(expected[2], "allow")
    assert rows[None].rule == "net/"
    assert urlfilter.judge(pages.where("false"), labels, URL_RULES).count() == 0


def test_rules_are_mined_pruned_and_matched(spark):
    bad, good = "http://cheap.shop.biz/pills/{}?ref=1", "http://cheap.shop.biz/news/{}"
    rows = [(i, (bad if i % 2 else good).format(i)) for i in range(200)] + [(900, bad.format(7)), (901, good.format(7)), (902, "http://other.biz/pills/1?ref=2")]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels, []).collect()}
    assert found[900] == "block" and found[901] == "allow" and found[902] == "block" and found[1] == "block" and found[2] == "allow"
    labelled = pages.where("page_id < 200").select(urlfilter.tokens(pages.url).alias("tokens"), (pages.page_id % 2 == 1).alias("block"))
    index = urlfilter.mine(labelled)
    assert {(r.size, r.token) for r in index.collect()} == {(1, "path1:pills"), (1, "query:?ref")}


def test_a_site_and_a_deep_segment_get_their_rules(spark):
    """Parts beyond the first and last labels and the second segment; a template of many parts is no burden."""
    deep = "/".join(f"s{i}" for i in range(20))
    rows = [(i, f"http://www.{'farm' if i % 3 == 0 else f'site{i % 7}'}.example.com/a/b", i % 3 == 0) for i in range(300)]
    rows += [(1000 + i, f"http://one.org/a/b/{'pills' if i % 2 else 'news'}/{i}", i % 2 == 1) for i in range(300)]
    rows += [(2000 + i, f"http://two.org/{deep}/{'x' if i % 2 else 'y'}", False) for i in range(200)]
    rows += [(3000 + i, f"http://three.org/{deep}/z", True) for i in range(200)]
    new = {5000: ("http://www.farm.example.com/c", "block"), 5001: ("http://www.site1.example.com/a/b", "allow"), 5002: ("http://one.org/q/r/pills/1", "block"), 5003: ("http://one.org/a/b/news/1", "allow"), 5004: (f"http://two.org/{deep}/x", "allow"), 5005: (f"http://four.org/{deep}/z", "block")}
    pages = spark.createDataFrame([(i, u, None) for i, u, _ in rows] + [(i, u, None) for i, (u, _) in new.items()], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels, []).collect()}
    assert {i: found[i] for i in new} == {i: v for i, (_, v) in new.items()}
    assert all(found[i] == ("block" if bad else "allow") for i, _, bad in rows)


def test_mined_rules_equal_their_sql(spark, tmp_path):
    """Planted sites and segments: the query's SQL mines the same rules from every part of the URLs."""
    import duckdb

    urls = [(i, f"http://www.{'Farm' if i % 3 == 0 else f'site{i % 7}'}.example.com/a/b/{i}", int(i % 3 == 0)) for i in range(240)]
    urls += [(1000 + i, f"https://one.org/a/b/{'pills' if i % 2 else 'news'}/{i}?p={i}&q=1{'#top' if i % 5 == 0 else ''}", i % 2) for i in range(200)]
    urls += [(2000 + i, f"http://m{i % 2}.two.info/{'x' if i % 4 < 2 else 'y'}", int(i % 4 == 0)) for i in range(400)]  # only the pair m0, x leads to the label
    urls += [(3000 + i, u, None) for i, u in enumerate(("http://www.farm.example.com/c", "http://www.site1.example.com/a/b", "http://q.biz/q/r/pills/1", "http://m0.two.info/x?1", "http://m1.two.info/x", "none", None, ""))]
    spark.createDataFrame([(i, u, None) for i, u, _ in urls] + [(0, "http://twice.biz/a", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, None, t) for i, _, t in urls] + [(5, None, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [tuple(r) for r in QUERIES["op4_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(repr, out)) == sorted(map(repr, c.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op4_url_filters']})").fetchall()))
    found = {r[0]: r[4] for r in out}
    assert [found[3000 + i] for i in range(8)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
