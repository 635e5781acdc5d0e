"""URL filters: fixed host and path rules first, then association rules mined by FP-growth.

A URL becomes a token for each of its parts: scheme, registered domain, every longer host suffix, first host label,
every path segment (numbers as #), depth, query parameter names, fragment. FP-growth over the labelled URLs' tokens
and their label finds the token combinations that lead to the label `block` with enough support and
confidence; combinations that contain a smaller such combination are pruned. Rules match by an inverted
index from token to rules: a rule fires on a URL that has all of its tokens. As the verdict depends on the
tokens alone, each distinct token set is matched once.

Support bounds what is mined, not a number of parts: tokens that too few blocked URLs have are left out first, and tokens
of exactly the same labelled URLs (a site's labels, a template's segments) are mined as one, any of which matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import pick, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)(#?.*)$"
BLOCK = "=block"
MIN_SUPPORT = 0.001
MIN_COUNT = 20
MIN_CONFIDENCE = 0.6


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """The URL's tokens, each with the name of its part; empty for null or no ://."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    segments = F.split(p, "/")
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    segment = lambda i: plain(F.split_part(p, F.lit("/"), F.lit(i)))
    query = F.regexp_replace(F.regexp_extract(url, PARTS, 3), "=[^&]*", "")
    parts = {
        "scheme:": F.regexp_extract(url, r"(?s)^(.*?)://", 1),
        "domain:": F.substring_index(h, ".", -2),
        "label:": F.when(F.size(labels) > 2, F.get(labels, F.lit(0))).otherwise(""),
        "path1:": segment(2),
        "path2:": segment(3),
        "depth:": F.least(F.size(segments) - 1, F.lit(9)).cast("string"),
        "query:": query,
        "fragment:": F.when(F.regexp_extract(url, PARTS, 4) != "", "#").otherwise(""),
    }
    named = F.array(*[F.when(v != "", F.concat(F.lit(k), v)) for k, v in parts.items()])
    starts = F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(starts, lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    deeper = F.transform(F.slice(segments, 4, F.size(segments)), lambda x, i: F.when(x != "", F.concat(F.lit("path"), (i + 3).cast("string"), F.lit(":"), plain(x))))
    return F.when(F.contains(url, F.lit("://")), F.array_compact(F.concat(named, suffixes, deeper))).otherwise(F.array().cast("array<string>"))


def fixed_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as 'verdict rule', or null. rules: (verdict, 'host/path').

    A rule fits its host and all its subdomains if the path starts with the rule's path.
    """
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit("/" + rest))
        out = F.when(fits, f"{verdict} {rule}").otherwise(out)
    return out


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame | None:
    """(rule long, size int, slot string, token string): the inverted index of the rules; None where there are none.

    A rule fires on a URL with a token in each of its `size` slots. labelled: (tokens array<string>, block boolean),
    every row counted. A combination must occur with the label in at least the share min_support of the rows, and in
    min_count rows; fewer rows yield no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where("block is not null").select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "block")
    rows = stored(rows, "url-labelled")
    n, blocked = rows.agg(F.count("*"), F.count_if("block")).first()
    least = max(min_support, min_count / n) if n else 2
    if blocked < max(1, least * n) or least > 1:
        return None
    each = rows.select("row", "block", F.explode("tokens").alias("token"))
    own = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in range(2)]  # names the set of rows
    often = each.groupBy("token").agg(F.count_if("block").alias("together"), *own).where(F.col("together") >= math.ceil(least * n))
    often = stored(often, "url-tokens")
    slots = often.join(often.groupBy("h0", "h1").agg(F.min("token").alias("slot")), ["h0", "h1"]).select("token", "slot")
    slots = stored(slots, "url-slots")
    reduced = each.join(slots.where("token = slot"), "token").groupBy("row").agg(F.collect_list("slot").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    rows = rows.select("row", "block").join(reduced, "row", "left").select(F.when(F.col("block"), F.array_append(items, F.lit(BLOCK))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(rows)
    # The itemsets are few; their confidences are ratios of two of their counts.
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    both = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("together"))
    rules = both.join(sets, "items").where(F.col("together") / F.col("freq") >= min_confidence).select("items", F.xxhash64("items").alias("rule"))
    rules = stored(rules, "url-rules")
    # Prune rules that contain a smaller rule: a smaller one meets all its supersets through the index.
    index = rules.select("rule", F.size("items").alias("size"), F.explode("items").alias("slot"))
    inside = index.alias("a").join(index.alias("b"), (F.col("a.slot") == F.col("b.slot")) & (F.col("a.size") < F.col("b.size")))
    larger = inside.groupBy(F.col("a.rule").alias("small"), F.col("a.size").alias("needed"), F.col("b.rule").alias("rule")).count().where("count = needed").select("rule").distinct()
    kept = stored(index.join(larger, "rule", "left_anti").join(slots, "slot").select("rule", "size", "slot", "token"), "url-index")
    return None if kept.isEmpty() else kept


def fired(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Of the distinct token sets (tokens), those on which a rule of the index fires."""
    named = sets.select(F.xxhash64("tokens").alias("set"), "tokens")
    hits = named.select("set", F.explode("tokens").alias("token")).join(index, "token").groupBy("set", "rule", "size").agg(F.size(F.collect_set("slot")).alias("met")).where("met = size")
    return named.join(hits.select("set").distinct(), "set", "left_semi").select("tokens")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "toxic", **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    verdict is the fixed rule's; without one, `block` if a mined rule fires, else `allow`. A page is labelled
    by the labels row with its id (a repeated id: the largest label; a null label: none). Repeated pages keep their rows and
    a null id its row; a null or empty url has no tokens, so no mined rule fires on it. A URL of any length is read whole:
    what it adds to the mining is bounded by the tokens that enough blocked URLs share. Without labels, or with fewer than
    min_count blocked ones, nothing is mined; an empty table of pages gives no rows.
    """
    own = pick(pages, page_id=id_col, url=url_col)
    marks = pick(labels, page_id=label_id, label=label_col).groupBy("page_id").agg((F.max("label") > 0).alias("block"))
    index = mine(own.join(marks, "page_id").select(tokens(F.col("url")).alias("tokens"), "block"), **mining)
    seen = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    ruled = seen.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    if index is None:
        ruled = ruled.withColumn("mined", F.lit(False))
    else:
        hit = stored(fired(seen.select("tokens").distinct(), index), "url-fired")
        ruled = ruled.join(hit.withColumn("mined", F.lit(True)), "tokens", "left")
    method = F.when(F.coalesce("mined", F.lit(False)), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.substring_index("fixed", " ", -1).alias("rule"), F.coalesce(F.substring_index("fixed", " ", 1), method).alias("verdict"))
