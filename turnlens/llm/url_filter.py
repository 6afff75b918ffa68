"""URL filter: listed rules first, mined association rules for the rest.

Listed rules name a host and a path; the longest one that fits decides. Its verdicts also label the
URLs it covers. From these labels Spark's FP-growth mines combinations of URL tokens (host labels,
their hyphen parts, path words, query keys) that imply a verdict. Rules below the support or the
confidence are pruned, and so is every rule that a shorter rule with the same verdict and at least its
confidence implies. The kept rules are matched by an inverted index from token to rule: a rule fires
when all its tokens are found. Of the rules that fire, the one with the highest confidence (then
support, then fewer tokens, then text order) decides; without any, the default does.

Tokens that stand in the same labelled URLs have the same rules. A rule with two of them is implied by the
same rule with one, so they are mined as one: a class of tokens. A long URL that recurs does not
multiply the token sets by its tokens, and a class matches where any of its tokens is found. Of a URL
that recurs in the support the subsets of its classes are mined; with more than ``LONGEST`` classes an error
asks for a higher support before that.

Null URLs and those without ``://`` have an empty host and path; no rule fits them. Repeated rows are
judged each for itself, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import saved

# The listed rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
VERDICTS = ("allow", "block")
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
#: Classes of tokens of one recurring URL, at most: its subsets are mined.
LONGEST = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tag(mark: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(mark), x)


def url_items(url: Column) -> Column:
    """Distinct tokens of a URL: ``h:`` host labels and their hyphen parts, ``p:`` path words, ``q:`` query keys."""
    host = F.split(host_of(url), r"\.")
    parts = F.flatten(F.transform(host, lambda x: F.concat(F.array(x), F.split(x, "-"))))
    words = F.regexp_extract_all(F.translate(path_of(url), UPPER, LOWER), F.lit("[a-z][a-z0-9_-]*"), F.lit(0))
    keys = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")),
                                F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    tagged = [F.transform(F.filter(a, lambda x: x != ""), tag(t))
              for a, t in ((parts, "h:"), (words, "p:"), (keys, "q:"))]
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tagged])))


def token_classes(labelled: DataFrame, least: float) -> DataFrame:
    """``token, class``: tokens of at least ``least`` labelled rows; those of the same rows share their smallest token's name.

    The rows of a token are known by their number and two 64-bit sums over the distinct token sets that hold it.
    """
    sets = labelled.groupBy("items", "verdict").agg(F.count("*").alias("n"))
    marks = [F.xxhash64("items", "verdict", F.lit(s)) for s in (1, 2)]
    rows = sets.select(F.explode("items").alias("token"), "n", *[m.alias(f"h{i}") for i, m in enumerate(marks)]) \
        .groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")).where(F.col("n") >= least)
    named = rows.groupBy("n", "h0", "h1").agg(F.min("token").alias("class"))
    return rows.join(named, ["n", "h0", "h1"]).select("token", "class", "n")


def mined_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT,
                  min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Pruned rules over classes (``tokens, verdict, confidence, support``), and the classes (``token, class``)."""
    total = labelled.count()
    classes = saved(token_classes(labelled, min_support * total))
    # one name for each class of tokens with enough support: at most the tokens of a mean URL / the support
    names = sorted(r["class"] for r in classes.select("class").distinct().collect())
    marks = [f"v:{v}" for v in VERDICTS]
    held = F.array_intersect("items", F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    baskets = labelled.select(held.alias("held"), "verdict").groupBy("held", "verdict").agg(F.count("*").alias("n"))
    baskets = saved(baskets)
    longest = baskets.where(F.col("n") >= min_support * total).agg(F.max(F.size("held"))).first()[0] or 0
    if longest > LONGEST:
        raise ValueError(f"a URL of {longest} independent tokens recurs in {min_support} of all rows: raise min_support")
    items = baskets.select(F.concat("held", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"), F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("n")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(
        F.element_at("consequent", 1).isin(marks) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, marks)))) \
        .select(F.array_sort("antecedent").alias("tokens"),
                F.substring(F.element_at("consequent", 1), 3, 100).alias("verdict"), "confidence", "support")
    rules = saved(rules)
    # a rule meets the shorter ones whose first token it holds
    a = rules.select("*", F.explode("tokens").alias("first")).alias("a")
    b = rules.select("tokens", "verdict", "confidence", F.element_at("tokens", 1).alias("first")).alias("b")
    implied = a.join(b, (F.col("a.first") == F.col("b.first")) & (F.col("a.verdict") == F.col("b.verdict"))
                     & (F.size("b.tokens") < F.size("a.tokens")) & (F.col("b.confidence") >= F.col("a.confidence"))
                     & (F.size(F.array_except("b.tokens", "a.tokens")) == 0), "left_semi").select("tokens", "verdict")
    return rules.join(implied.distinct(), ["tokens", "verdict"], "left_anti"), classes.select("token", "class")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens, verdict, confidence, support`` mined from ``items, verdict`` rows; pruned, one rule for each choice of tokens."""
    rules, classes = mined_classes(labelled, min_support, min_confidence)
    members = classes.groupBy("class").agg(F.collect_list("token").alias("names"))
    each = rules.select(F.xxhash64("tokens", "verdict").alias("rule"), "verdict", "confidence", "support",
                        F.explode("tokens").alias("class")).join(members, "class")
    choices = each.groupBy("rule", "verdict", "confidence", "support").agg(F.collect_list("names").alias("slots"))
    grown = F.aggregate("slots", F.array(F.array().cast("array<string>")), lambda acc, names: F.flatten(
        F.transform(acc, lambda t: F.transform(names, lambda n: F.array_append(t, n)))))
    return choices.select(F.explode(grown).alias("t"), "verdict", "confidence", "support") \
        .select(F.array_sort("t").alias("tokens"), "verdict", "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """``items, mined``: the verdict of the best rule that fires, for each distinct token set.

    A rule fires if each of its classes has a token there; its text is that of the smallest such tokens.
    """
    index = rules.select(F.xxhash64("tokens", "verdict").alias("rule"), "verdict", "confidence", "support", F.size("tokens").alias("n"),
                         F.explode("tokens").alias("class")).join(classes, "class")
    found = urls.select("items").distinct().select("items", F.explode("items").alias("token")).join(index, "token") \
        .groupBy("items", "rule", "class", "verdict", "confidence", "support", "n").agg(F.min("token").alias("token")) \
        .groupBy("items", "rule", "verdict", "confidence", "support", "n") \
        .agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("text")).where("hits = n")
    best = F.min_by("verdict", F.struct(-F.col("confidence"), -F.col("support"), "n", "text", "verdict"))
    return found.groupBy("items").agg(best.alias("mined"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               default: str = DEFAULT) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        F.when(url.contains("://"), url_items(url)).otherwise(F.array().cast("array<string>"))
                        .alias("items"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    labelled = rows.where("verdict IS NOT NULL AND size(items) > 0").select("items", "verdict")
    # rows that a list decides, or that have no tokens, meet no rule: the others alone are joined by their tokens
    is_open = F.col("verdict").isNull() & (F.size("items") > 0)
    mined = match_rules(rows.where(is_open), *mined_classes(labelled, min_support, min_confidence))
    out = [F.col("id").alias(id_col), "host", "path", "rule"]
    settled = rows.where(~is_open).select(*out, F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return settled.unionByName(rows.where(is_open).join(mined, "items", "left")
                               .select(*out, F.coalesce("mined", F.lit(default)).alias("verdict")))
