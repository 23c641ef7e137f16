"""URL filter by two character language models, in DataFrame operations.

URLs that a rule accepts train one model, those that a rule rejects the other: smoothed
Markov models of variable order, in which each context falls back on the next shorter one
(p(c | ctx) = (n(ctx c) + a p(c | shorter)) / (n(ctx) + a)). Counts are exact, over all labelled URLs
but one fold (a fifth of the distinct URLs). A URL's score is the difference of its two log-likelihoods
over its length; the threshold is the one that parts that fold best, either class weighing the same.
URLs without a rule are allowed at the threshold or above; URLs under a rule follow it.

A character's share of the score depends on the ``ORDER`` characters that end with it alone. So the models are
a table of distinct such grams, whose shorter ones are sums over it, and each gram gets its weight once, level by
level; URLs, each distinct one once, are joined with the weights of their grams. Grams that make up a ``HEAVY``-th
of all, and URLs of that share of the pages, are few by that bound and are broadcast, the others shuffled. Weights are
summed as whole numbers of 2**-32, so reruns agree.

A null or empty url has no characters and scores 0; very long ones are read whole. Where a class has no URL to
learn from, what no rule blocks is allowed. Equal urls (digits and case of A-Z aside, known by 128 bits) fare alike;
rows of one id are judged each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import passing, staged

ORDER, ALPHA = 5, 4.0
#: Keys of more than this part of all rows are broadcast in joins; there are this many at most.
HEAVY = 4096
UNIT = float(1 << 32)
URL = ["u1", "u2"]
#: Scores are compared in steps of 1/64 from -8 to 8 for the threshold.
STEP = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shape(url: Column) -> Column:
    """What the models see: lower case, digits as 0, ends marked."""
    return F.concat(F.lit("\x02" * (ORDER - 1)),
                    F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9), F.lit("\x03"))


def _grams(urls: DataFrame, *keep: Column | str) -> DataFrame:
    """(keep…, gram): for every character of a shaped url, the ``ORDER`` characters that end with it."""
    chars = urls.select(*keep, F.split("shape", "").alias("_c"))
    ends = F.sequence(F.lit(ORDER - 1), F.size("_c") - 1)
    gram = F.transform(ends, lambda i: F.concat(*[F.get("_c", i - k) for k in range(ORDER - 1, -1, -1)]))
    return chars.select(*[c for c in chars.columns if c != "_c"], F.explode(gram).alias("gram"))


def distinct_urls(rows: DataFrame) -> DataFrame:
    """(u1, u2, shape, allow, block, asked) of rows (shape, by_rule): how many rows a rule accepts, rejects, leaves."""
    is_ = lambda v: F.count(F.when(v, 1))
    return rows.groupBy("shape").agg(
        is_(F.col("by_rule") == "allow").alias("allow"), is_(F.col("by_rule") == "block").alias("block"),
        is_(F.col("by_rule").isNull()).alias("asked")).select(*_url_key(), "shape", "allow", "block", "asked")


def _url_key() -> tuple[Column, Column]:
    return F.xxhash64("shape").alias("u1"), F.xxhash64(F.lit(1), "shape").alias("u2")


def _held_out() -> Column:
    return F.pmod("u1", F.lit(5)) == 0


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, allow, block, uses) of distinct urls: occurrences in the URLs that each class learns from, and in
    the URLs that need a score."""
    learn = lambda c: F.when(~_held_out(), F.col(c)).otherwise(F.lit(0)).alias(c)
    found = _grams(urls, learn("allow"), learn("block"), _needs_score().cast("int").alias("uses"))
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("allow", "block", "uses")])


def _needs_score() -> Column:
    return (F.col("asked") > 0) | _held_out() & (F.col("allow") + F.col("block") > 0)


def weights(grams: DataFrame) -> DataFrame:
    """(gram, uses, weight): the gram's share of the score in units of 2**-32. A level's rows of one context, or of
    one shorter gram, are as many as there are characters at most."""
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        longer = levels[k + 1].select(F.substring("gram", 2, k).alias("gram"), "allow", "block")
        levels[k] = longer.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    total = levels[1].agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    known = None
    for k in range(1, ORDER + 1):
        now = levels[k]
        if k == 1:
            shorter = {c: F.lit(1.0 / 256) for c in ("allow", "block")}
            context = {c: F.lit(total[c]) for c in shorter}
        else:
            now = now.join(known, F.substring("gram", 2, k - 1) == F.col("tail")).drop("tail")
            by = Window.partitionBy(F.substring("gram", 1, k - 1))
            shorter = {c: F.col("p_" + c) for c in ("allow", "block")}
            context = {c: F.sum(c).over(by) for c in shorter}
        p = {c: ((F.col(c) + ALPHA * shorter[c]) / (context[c] + ALPHA)).alias("p_" + c) for c in shorter}
        if k < ORDER:
            known = now.select(F.col("gram").alias("tail"), *p.values())
    weight = F.log(p["allow"]) - F.log(p["block"])
    return now.select("gram", "uses", F.round(weight * UNIT).cast("long").alias("weight"))


def _spread_join(left: DataFrame, right: DataFrame, on: list[str], uses: str) -> DataFrame:
    """Inner join with a table of distinct keys that counts in ``uses`` how many rows of ``left`` it meets."""
    least = (right.agg(F.sum(uses).alias("n")).first().n or 0) / HEAVY
    heavy, light = right.filter(F.col(uses) > least).drop(uses), right.filter(F.col(uses) <= least).drop(uses)
    few = left.join(F.broadcast(heavy), on)
    return few.unionByName(left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on))


def scores(urls: DataFrame, weighed: DataFrame) -> DataFrame:
    """(u1, u2, score) of the distinct urls that need one: log-likelihood difference, accepted less rejected, by
    length; 0 without characters."""
    rows = _grams(urls.filter(_needs_score()), *URL)
    total = _spread_join(rows, weighed.filter("uses > 0"), ["gram"], "uses").groupBy(*URL).agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return total.select(*URL, F.when(F.col("n") > 1, F.col("weight") / UNIT / F.col("n")).otherwise(F.lit(0.0)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The step at which the shares of wrongly judged (score, verdict) rows, each ``n`` times, add up to the least."""
    step = F.least(F.greatest(F.floor(F.col("score") * STEP), F.lit(-8 * STEP)), F.lit(8 * STEP))
    counts = scored.groupBy(step.alias("s")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("b")).collect()  # 1025 steps at most
    total_a, total_b = sum(r.a for r in counts) or 1, sum(r.b for r in counts) or 1
    best, at, lost, kept = None, 0.0, 0, total_b
    for r in [None, *sorted(counts, key=lambda r: r.s)]:
        if r is not None:
            lost, kept = lost + r.a, kept - r.b
        wrong = lost / total_a + kept / total_b
        if best is None or wrong < best - 1e-12:
            best, at = wrong, -8.0 if r is None else (r.s + 1) / STEP
    return at


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): verdict by the longest rule, else by the models."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), _shape(F.col("url")).alias("shape"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    out = ["page_id", "host", "path", "rule", "by_rule"]
    ruled, free = rows.filter("by_rule is not null"), rows.filter("by_rule is null")
    with passing(pages.sparkSession):
        urls = staged(distinct_urls(rows), "urls", last=True)
        seen = urls.filter(~_held_out()).agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
        if not (seen.a and seen.b):
            return rows.select(*out[:-1], F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
        weighed = staged(weights(staged(gram_counts(urls), "grams")), "weights")
        scored = staged(scores(urls, weighed).join(urls.drop("shape"), URL), "scores", last=True)
    folds = scored.filter(_held_out())
    at = threshold(folds.select("score", F.lit("allow").alias("verdict"), F.col("allow").alias("n")).union(
        folds.select("score", F.lit("block"), "block")))
    free = _spread_join(free.select(*out, *_url_key()), scored.filter("asked > 0").select(*URL, "score", "asked"), URL, "asked")
    rows = ruled.select(*out, F.lit(None).cast("double").alias("score")).union(free.select(*out, "score"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return rows.select(*out[:-1], verdict.alias("verdict"), "score")
