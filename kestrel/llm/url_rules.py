"""URL filtering: fixed host/path rules, then association rules mined by FP-growth.

Fixed rules win: a rule fits its host and all subdomains if the URL's path starts
with the rule's path; of several that fit the longest (host and path together) wins.

Every other URL is judged by association rules.  A URL becomes a set of tokens (host
labels, path words, query keys).  The URLs that a fixed rule decides are the labelled
ones - or those that the caller labels.  A rule {tokens} -> block needs ``MIN_URLS`` bad
URLs that hold its tokens (a number, not a share, so that more pages never remove a rule)
and a large enough share of bad ones among all that hold them (confidence); one whose
tokens hold those of another rule is pruned, for it decides nothing more.

Mining.  Tokens that the same labelled URLs hold are one class: a long URL, repeated or
not, adds as many items as it has classes, not tokens.  Any token of a class stands for it,
in rules and in URLs.  Confident classes are rules by themselves and leave the baskets;
FP-growth finds the frequent sets of the others, whose subsets are exponential in the
basket.  So where some bad basket still holds over ``LONGEST`` classes, or the classes are
too many for FP-growth's item list on the driver (``MAX_ITEMS``), the same rules are grown
level by level by joins on the URL, and only from sets of which no part is confident.

Rules are matched by an inverted index: each rule is posted under its rarest class, a URL's
classes look up their postings, and only then are a candidate's others compared.  Mined
rules are counted before they are broadcast; too many are joined by shuffle.

Defined results: a null URL or one without ``://`` has empty host and path and is
allowed; without labels no rule is mined and all else is allowed; repeated rows are
judged alike (and each counts as support); a token that every labelled URL holds is in no
rule; of several rules that match the most confident one's confidence is told, the verdict
is the same; a very long URL is a larger token set, read whole; null ids are answered;
columns other than id and URL are never read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.storage import materialize

#: (verdict, host, path): the fixed rules (contract values).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BAD = "\u0000bad"  # no token holds a NUL: URLs are split at everything but letters, digits, - and .
#: Least number of labelled URLs behind a rule, and its least confidence.
MIN_URLS, MIN_CONFIDENCE = 5, 0.9
#: Rules broadcast at most; more are joined by shuffle.
MAX_RULES = 200_000
#: FP-growth takes baskets of so many classes at most (2^n subsets of each), and so many classes in all on the driver.
LONGEST, MAX_ITEMS = 12, 200_000


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words that are no numbers, query keys."""
    h, p = host(url), path(url)
    labels = F.transform(F.split(h, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.regexp_extract_all(F.lower(p), F.lit(r"[\p{L}\p{N}-]*[\p{L}-][\p{L}\p{N}-]*"), 0), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([\w-]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, words, keys)))


def token_classes(told: DataFrame, min_urls: int) -> DataFrame:
    """(token, cls, n, b): tokens of ``told(u, bad, tokens)`` in ``min_urls`` bad URLs or more, named by their class.

    Tokens held by the same URLs are one class; n URLs hold it, b bad ones.
    """
    held = told.select("u", F.col("bad").cast("int").alias("bad"), F.explode("tokens").alias("token")).groupBy("token")
    seen = held.agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"),
        # 128 bits of the set of URLs.
        F.bit_xor(F.xxhash64("u", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(2))).alias("y"),
    ).where(F.col("b") >= min_urls)
    seen, _ = materialize(seen, "tokens")
    named = seen.groupBy("n", "b", "x", "y").agg(F.min("token").alias("cls"))
    return materialize(seen.join(named, ["n", "b", "x", "y"]).select("token", "cls", "n", "b"), "classes")[0]


def _by_fp_growth(baskets: DataFrame, min_urls: int, min_confidence: float) -> DataFrame:
    """(items, confidence, support as a number) from ``baskets(u, bad, items)``."""
    marked, _ = materialize(
        baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets"
    )
    held = marked.count()
    # Half an URL less, so that rounding of the share never asks for one more.
    model = FPGrowth(itemsCol="items", minSupport=(min_urls - 0.5) / held, minConfidence=min_confidence).fit(marked)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    return rules.select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * held).alias("support"))


def _by_levels(baskets: DataFrame, min_urls: int, min_confidence: float) -> DataFrame:
    """The same rules, but for those that hold another: sets grown by one class from sets without a confident part."""
    single, _ = materialize(baskets.select("u", "bad", F.explode("items").alias("cls")), "items")
    holds = single.select("u", "bad", F.array("cls").alias("items"))
    rules = None
    while True:
        grown = holds.join(single.select("u", "cls"), "u").where(F.col("cls") > F.element_at("items", -1))
        grown = grown.select("u", "bad", F.concat("items", F.array("cls")).alias("items"))
        known = holds.select("items").distinct()
        counted = grown.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("b")).where(F.col("b") >= min_urls)
        # Every part one class shorter must be frequent and not confident itself.
        parts = counted.select("n", "b", F.col("items").alias("whole"), F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("items"))
        open_parts = parts.join(known, "items", "left_semi").groupBy("whole", "n", "b").agg(F.count(F.lit(1)).alias("k"))
        sets, _ = materialize(open_parts.where(F.col("k") == F.size("whole")).select(F.col("whole").alias("items"), "n", "b"), "sets")
        confident = F.col("b") >= F.col("n") * min_confidence
        found = sets.where(confident).select("items", (F.col("b") / F.col("n")).alias("confidence"), F.col("b").cast("double").alias("support"))
        rules = found if rules is None else rules.unionByName(found)
        left = sets.where(~confident).select("items")
        if left.isEmpty():
            return rules
        holds, _ = materialize(grown.join(left, "items"), "holds")


def mine(labelled: DataFrame, min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, confidence, support) over classes and classes (token, cls), from ``labelled(tokens, bad)``."""
    # The ids are written before tokens are exploded, so that they stay.
    told, _ = materialize(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("u"), "bad", "tokens"), "told")
    n = told.count()
    classes = token_classes(told, min_urls).where(F.col("n") < n)
    alone = classes.where(F.col("token") == F.col("cls"))
    confident = F.col("b") >= F.col("n") * min_confidence
    rules = alone.where(confident).select(F.array("cls").alias("items"), (F.col("b") / F.col("n")).alias("confidence"), F.col("b").cast("double").alias("support"))
    rest = alone.where(~confident).select(F.col("token"), "cls")
    items = rest.count()
    if items > 1:
        if items <= MAX_RULES:
            rest = F.broadcast(rest)
        # A class's first token stands for it: the same URLs hold all its tokens.
        one = told.select("u", "bad", F.explode("tokens").alias("token")).join(rest, "token")
        baskets = one.groupBy("u", "bad").agg(F.array_sort(F.collect_list("cls")).alias("items")).where(F.size("items") > 1)
        baskets, _ = materialize(baskets, "open")
        longest = baskets.where("bad").agg(F.max(F.size("items"))).first()[0]
        if longest is not None:
            way = _by_fp_growth if longest <= LONGEST and items <= MAX_ITEMS else _by_levels
            rules = rules.unionByName(way(baskets, min_urls, min_confidence))
    rules = rules.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", (F.col("support") / max(n, 1)).alias("support"))
    return materialize(rules, "mined")[0], classes.select("token", "cls")


def _postings(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(cls, rule_id, items, confidence): each rule under its rarest class by ``frequency(cls, n)``."""
    rarest = (
        rules.select("rule_id", F.explode("items").alias("cls"))
        .join(frequency, "cls", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "cls")).alias("r"))
        .select("rule_id", F.col("r.cls").alias("cls"))
    )
    postings, _ = materialize(rules.join(rarest, "rule_id").select("cls", "rule_id", "items", "confidence"), "postings")
    return F.broadcast(postings) if postings.count() <= MAX_RULES else postings


def pruned(rules: DataFrame) -> DataFrame:
    """Rules whose items hold no other rule's."""
    frequency = rules.select(F.explode("items").alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    short = _postings(rules, frequency).alias("s")
    long = rules.select(F.col("rule_id").alias("long"), F.col("items").alias("held"), F.explode("items").alias("cls")).alias("l")
    part = (F.size("s.items") < F.size("l.held")) & (F.size(F.array_except("s.items", "l.held")) == 0)
    beaten = long.join(short, (F.col("l.cls") == F.col("s.cls")) & part).select(F.col("long").alias("rule_id")).distinct()
    return rules.join(beaten, "rule_id", "left_anti")


def matches(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, confidence): the strongest rule matching each row of ``pages(row, tokens)`` that any matches."""
    used = rules.select(F.explode("items").alias("cls")).distinct()
    known, _ = materialize(classes.join(used, "cls", "left_semi"), "known")
    if known.count() <= MAX_RULES:
        known = F.broadcast(known)
    held = pages.select("row", F.explode("tokens").alias("token")).join(known, "token")
    sets, _ = materialize(held.groupBy("row").agg(F.collect_set("cls").alias("held")), "held")
    frequency = sets.select(F.explode("held").alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    found = sets.select("row", "held", F.explode("held").alias("cls")).join(_postings(rules, frequency), "cls")
    return found.where(F.size(F.array_except("items", "held")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """__id, host, path, rule, verdict, confidence for ``pages(__id, url)``.

    ``labels(__id, bad)`` name the pages to learn from; without them those decided by ``rules`` teach.
    """
    url = F.col("url").cast("string")
    rule, verdict = fixed(F.col("host"), F.col("path"), rules)
    rows, _ = materialize(
        pages.select(
            "__id",
            host(url).alias("host"),
            path(url).alias("path"),
            F.coalesce(tokens(url), F.array().cast("array<string>")).alias("tokens"),
            F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("rule", rule)
        .withColumn("fixed", verdict),
        "urls",
    )
    if labels is None:
        taught = rows.where("fixed IS NOT NULL").select("tokens", (F.col("fixed") == "block").alias("bad"))
    else:
        taught = rows.join(labels, "__id").select("tokens", "bad")
    mined, classes = mine(taught)
    found, _ = materialize(pruned(mined), "rules")
    if found.limit(1).count():
        hit = matches(rows.where("fixed IS NULL").select("row", "tokens"), found, classes)
        rows = rows.join(hit, "row", "left")
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    return rows.select(
        "__id",
        "host",
        "path",
        "rule",
        F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``, learned from the fixed rules' verdicts."""
    return judge(pages.select(F.col("page_id").alias("__id"), "url")).select(
        F.col("__id").alias("page_id"), "host", "path", "rule", "verdict"
    )
