"""URL filter: curated rules, extended by mined association rules.

*Curated rules* name a host and a path prefix; a rule fits its host and every
subdomain when the path starts with the rule's. The longest fitting rule wins.

*Mined rules.* The urls that curated rules decide are the labelled rows. Each
url becomes a set of tokens (scheme, host labels, path segments; digits are
folded, so ids do not make tokens of their own). Tokens that occur in the very
same labelled urls count as one. Spark's FP-growth counts the
frequent token sets together with a label item; those implying a label with
enough support and confidence become rules, and a rule that is no surer than
a more general one with the same verdict is pruned. A url that no curated rule
fits is matched through an inverted index from token to rules: a rule matches
when as many of its tokens are met as it has. The surest, then best supported,
then longest rule decides; where none matches the url is allowed.

Nulls and urls without ``://`` have an empty host and path and are allowed by
the default. Repeated rows each get their row, urls may be of any length, and
ties go as said above. An empty table gives no rows. Columns other than the id
and the url are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.session import materialize

Rule = tuple[str, str]
#: (rule, verdict): the rule's host up to its first slash, its path from there.
RULES: tuple[Rule, ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def curated(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: F.concat(F.lit("path:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.coalesce(F.lower(F.regexp_extract(url, "^([^:/]*)://", 1)), F.lit(""))))
    kept = F.filter(F.concat(labels, parts, scheme), lambda x: ~x.isin("host:", "path:", "scheme:"))
    return F.array_sort(F.array_distinct(kept))


def classes(labelled: DataFrame, least: float) -> DataFrame:
    """``labelled(row, tokens)``: ``(token, rep)`` for each token that occurs in the very rows of ``rep``, the least such token.

    Tokens that always occur together would make two to the power of their number of equal patterns.
    """
    each = labelled.select("row", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= least)
    reps = held.groupBy("n", "mark0", "mark1").agg(F.min("token").alias("rep"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    return held.join(reps, ["n", "mark0", "mark1"]).where("token <> rep").select("token", "rep")


def _by_class(rows: DataFrame, key: str, same: DataFrame) -> DataFrame:
    """``rows(key, token)`` with the classes' tokens for their members', each once."""
    return rows.join(same, "token", "left").select(key, F.coalesce("rep", "token").alias("token")).distinct()


def mine(labelled: DataFrame, same: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``labelled(row, tokens, verdict)``: rules ``(rule_id, tokens, verdict, confidence, support)`` of the tokens that stand for classes."""
    own = _by_class(labelled.select("row", F.explode("tokens").alias("token")), "row", same).groupBy("row").agg(F.collect_set("token").alias("tokens"))
    items = labelled.select("row", "verdict").join(own, "row").select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support"
    )
    found = materialize(found.withColumn("rule_id", F.array_join("tokens", " ")))
    # a longer rule goes when a part of it is as sure of the same verdict: rules meet through a shared token
    whole = found.select("rule_id", "verdict", "confidence", F.explode("tokens").alias("token"), F.size("tokens").alias("n"))
    part = found.select(F.col("rule_id").alias("general"), F.col("verdict"), F.col("confidence").alias("c"), F.explode("tokens").alias("token"), F.size("tokens").alias("m"))
    covered = whole.join(part, ["token", "verdict"]).where("m < n AND c >= confidence").groupBy("rule_id", "general", "m").count().where("count = m")
    return found.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")


def match(sets: DataFrame, same: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(key, tokens)``: the best mined rule ``(key, mined, mined_verdict)`` of each set that one matches."""
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    met = _by_class(sets.select("key", F.explode("tokens").alias("token")), "key", same).join(index, "token")
    full = met.groupBy("key", "rule_id", "verdict", "confidence", "support", "need").count().where("count = need")
    best = full.groupBy("key").agg(F.max(F.struct("confidence", "support", "need", "rule_id", "verdict")).alias("best"))
    return best.select("key", F.col("best.rule_id").alias("mined"), F.col("best.verdict").alias("mined_verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, min_support: float = 0.01, min_confidence: float = 0.9, default: str = "allow") -> DataFrame:
    """``pages(page_id, url)``: page_id, host, path, rule, verdict, and the mined rule that decided, if one did."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    base = base.withColumns({"hit": curated(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    labelled = base.where("hit IS NOT NULL").select("tokens", F.col("hit.verdict").alias("verdict"))
    # a row's number is given once, when the table is written
    labelled = materialize(labelled.withColumn("row", F.monotonically_increasing_id()))
    columns = ["page_id", "host", "path", "rule", "verdict", "mined"]
    if (count := labelled.count()) == 0:
        return base.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    open_ = base.where("hit IS NULL").withColumn("key", F.array_join("tokens", " "))
    sets = open_.groupBy("key").agg(F.first("tokens").alias("tokens"))
    same = materialize(classes(labelled, min_support * count))
    # written, so that the join below is one of its own and a frequent key's rows can be split
    best = materialize(match(sets, same, mine(labelled, same, min_support, min_confidence)))
    rest = open_.select("page_id", "host", "path", "key").join(best, "key", "left")
    rest = rest.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.coalesce("mined_verdict", F.lit(default))})
    sure = base.where("hit IS NOT NULL").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    return sure.select(columns).unionAll(rest.select(columns))
