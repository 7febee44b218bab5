"""URL filter: host and path rules, and association rules mined by FP-growth.

Explicit rules win, the longest that fits; of equally long ones the last given.
URLs that none fits are judged by rules {tokens} -> bad that Spark's FP-growth
mines from labelled pages, pruned by support, confidence and lift and without
rules that a more general one implies. Tokens that stand in the same pages are
one item, and in FP-growth a page counts with its most telling items, so that
itemsets stay few however long the URLs are. Where that leaves items out, the
sets of all items are counted level by level, without a limit on items.
The rules are filed by their rarest token; a URL looks up its own tokens in
that inverted index and tests only the rules filed there. Everything is a
column expression, so judging is one narrow pass.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import lower_ascii, small, stored

#: Verdict, host suffix, path prefix.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BAD = "=bad"
SLOTS = 256
#: A rule's least pages, its least lift over the share of bad pages, and the most items of a page in FP-growth.
LEAST_PAGES, LEAST_LIFT, MOST_ITEMS = 20, 1.5, 8
RULE_KIND = "array<array<struct<key:string,tokens:array<string>,confidence:double,support:double>>>"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: host suffixes, host labels, path segments and query keys; numbers are one token."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(lower_ascii(p), r"^[0-9]+", "#"), r"[0-9]{3,}", "#")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query:"), F.substring_index(q, "=", 1)))
    words = F.transform(F.filter(F.split(F.element_at(labels, 1), "-"), lambda w: F.length(w) > 3), lambda w: F.concat(F.lit("word:"), w))
    found = F.concat(F.when(host != "", F.concat(suffixes, words)).otherwise(F.array().cast("array<string>")), parts, keys)
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t.isNotNull()))


def base_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def held_items(labelled: DataFrame, least: int) -> DataFrame:
    """(row, bad, token, tells): each frequent item of each labelled page.

    Items are tokens of at least ``least`` pages. Tokens with the same pages,
    told by count and a sum of hashes, are one item under the smallest name. An
    item is the more telling the further its share of bad pages is from that of
    all.
    """
    pages = labelled.where("url is not null and bad is not null").select(F.col("bad"), tokens_of(F.col("url")).alias("tokens"), F.xxhash64("url").alias("page"))
    share = F.lit(pages.agg(F.avg(F.col("bad").cast("double"))).first()[0] or 0.0)
    told = pages.select("bad", "page", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.avg(F.col("bad").cast("double")).alias("own"), F.sum(F.shiftright("page", 32)).alias("pages"), F.sum(F.col("page").bitwiseAND(0xFFFFFFFF)).alias("more"))
    items = told.where(F.col("n") >= least).groupBy("n", "pages", "more").agg(F.min("token").alias("token"), F.first("own").alias("own"))
    items = items.select("token", F.abs(F.col("own") - share).alias("tells"))
    rows = pages.select("bad", "tokens", F.monotonically_increasing_id().alias("row"))
    return rows.select("row", "bad", F.explode("tokens").alias("token")).join(small(stored(items, "url-items")), "token").select("row", "bad", "token", "tells")


def baskets(held: DataFrame, most: int) -> DataFrame:
    """(items, n_items, bad) of each page of ``held_items``: its ``most`` telling items, ties by name, and their number before the cut."""
    held = held.groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct((-F.col("tells")).alias("k"), F.col("token").alias("t")))).alias("all"))
    return held.select(F.transform(F.slice("all", 1, most), lambda x: x["t"]).alias("items"), F.size("all").alias("n_items"), "bad")


def counted_sets(held: DataFrame, least: int) -> DataFrame:
    """(tokens, n, bad): sets of items of whole pages, sorted, with their pages and bad pages, at least ``least``.

    Level by level: a set grows by a later item of its pages. It is left where
    a smaller one has the same pages, or bad pages alone, as that one then
    implies it and all larger ones; so long paths, whose parts imply each
    other, don't multiply sets, and none that a rule can need is missed.
    """
    count = [F.count("*").alias("n"), F.count_if("bad").alias("bad")]
    members = held.select("row", "bad", F.array("token").alias("tokens"))
    level = stored(members.groupBy("tokens").agg(*count).where(F.col("bad") >= least), "url-sets")
    levels = [level]
    while True:
        live = level.where("bad < n")
        if live.isEmpty():
            break
        members = stored(members.join(live.select("tokens"), "tokens"), "url-members")
        grown = members.join(held.select("row", "token"), "row").where(F.col("token") > F.element_at("tokens", -1))
        grown = grown.select("row", "bad", F.concat("tokens", F.array("token")).alias("tokens"))
        sets = grown.groupBy("tokens").agg(*count).where(F.col("bad") >= least)
        part = F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part")
        kept = sets.select("*", part).join(live.select(F.col("tokens").alias("part"), F.col("n").alias("part_n")), "part").where("part_n > n")
        level = stored(kept.groupBy("tokens", "n", "bad").agg(F.count("*").alias("parts")).where(F.col("parts") == F.size("tokens")).drop("parts"), "url-sets")
        members = grown
        levels.append(level)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def mine_rules(labelled: DataFrame, *, support: float = 0.002, confidence: float = 0.8, pages: int = LEAST_PAGES, lift: float = LEAST_LIFT, items: int = MOST_ITEMS) -> list[dict]:
    """Rules {tokens, confidence, support, lift, cut_share, mined} -> bad from rows (url, bad boolean).

    A rule holds for ``support`` of the labelled pages and at least ``pages`` of
    them, with ``confidence`` and ``lift`` over the share of bad pages. It goes
    if one with fewer of its tokens has the same confidence or more. Rows
    without url or label are left out. cut_share is the share of pages that had
    more than ``items`` items, which FP-growth can't see whole. If there are
    any, rules are counted on whole pages (``counted_sets``), and mined tells
    those that FP-growth found too. The driver gets the pruned rules alone,
    whose number does not follow the rows.
    """
    labelled = labelled.where("url is not null and bad is not null")
    total, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return []
    least = max(pages, int(support * total))
    whole = stored(held_items(labelled, least), "page-items")
    held = stored(baskets(whole, items), "baskets")
    rows, cut = held.agg(F.count("*"), F.count_if(F.col("n_items") > items)).first()
    if not rows:
        return []
    sets = held.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / rows), minConfidence=confidence).fit(sets).associationRules
    found = found.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", F.lit(True).alias("mined"))
    if cut:
        seen = found.select("tokens", "mined")
        found = counted_sets(whole, least).select("tokens", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(rows)).alias("support")).where(F.col("confidence") >= confidence)
        found = found.join(seen, "tokens", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    found = stored(found.where(F.col("confidence") >= lift * bad / total), "rules")
    masks = F.sequence(F.lit(1), (F.lit(2) ** F.size("tokens")).cast("int") - 2)
    parts = F.transform(masks, lambda m: F.filter("tokens", lambda t, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))
    general = found.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode(parts).alias("part")).alias("r").join(found.alias("g"), (F.col("r.part") == F.col("g.tokens")) & (F.col("g.confidence") >= F.col("r.confidence")))
    kept = found.join(general.select("r.tokens").distinct(), "tokens", "left_anti").orderBy("tokens").collect()
    return [{"tokens": r["tokens"], "confidence": float(r["confidence"]), "support": float(r["support"]) * rows / total, "lift": float(r["confidence"]) * total / bad, "cut_share": cut / rows, "mined": r["mined"]} for r in kept]


def inverted_index(rules: list[dict]) -> Column:
    """A constant array of slots; a rule stands in the slot of its rarest token."""
    df = {}
    for r in rules:
        for t in r["tokens"]:
            df[t] = df.get(t, 0) + 1
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for r in rules:
        key = min(r["tokens"], key=lambda t: (df[t], t))
        slots[sum(key.encode()) % SLOTS].append(r | {"key": key})
    return F.from_json(F.lit(json.dumps(slots)), RULE_KIND)


def _slot(token: Column) -> Column:
    """The same sum of bytes as in inverted_index."""
    raw = F.hex(F.encode(token, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(byte, F.lit(0), lambda a, b: a + b) % SLOTS


def judge_urls(pages: DataFrame, labelled: DataFrame, *, rules=RULES, support: float = 0.002, confidence: float = 0.8, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence), one row for each row of ``pages``.

    The explicit rules are (verdict, host suffix, path prefix); a URL that none
    fits is blocked if a mined rule matches, else allowed. confidence is the
    best matching mined rule's, else null. Host: after the first ``://`` to
    ``/``, ``?``, ``#`` or the end, A-Z folded; path: from there to ``?``,
    ``#`` or the end. A null URL or one without ``://`` has both empty and is
    allowed. Null and repeated page_ids are kept row by row, other columns are
    ignored, and empty tables give an empty result or no mined rules.
    """
    mined = mine_rules(labelled, support=support, confidence=confidence, pages=least_pages)
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    name, verdict = base_rule(F.col("host"), F.col("path"), rules)
    best = F.lit(None).cast("double")
    if mined:
        index = inverted_index(mined)
        own = F.col("tokens")
        filed = F.flatten(F.transform(own, lambda t: F.filter(F.element_at(index, _slot(t) + 1), lambda r: (r["key"] == t) & F.forall(r["tokens"], lambda x: F.array_contains(own, x)))))
        best = F.array_max(F.transform(filed, lambda r: r["confidence"]))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), tokens_of(url).alias("tokens"))
    told = told.select("page_id", "host", "path", name.alias("rule"), verdict.alias("base"), best.alias("confidence"))
    return told.select("page_id", "host", "path", "rule", F.coalesce("base", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
