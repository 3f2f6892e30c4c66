"""URL filters with DataFrame and SQL functions alone: listed rules, then association rules mined by FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import deals, dropped, pick, sized, written

BAD = "=bad"
#: Mined rules: least share of labelled urls and least urls that hold a combination and are bad; least share of bad ones
#: among those that hold it, absolutely and against all urls'; least deviations by which chance falls short of it.
SUPPORT, LEAST_URLS, CONFIDENCE, LIFT, LEAST_Z = 0.001, 20, 0.5, 1.5, 4.5
#: A token that so many urls hold tells nothing, and stands in no rule.
MOST_SHARE = 0.9


@dataclass(frozen=True)
class Rule:
    """A listed rule for ``host`` and its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The listed rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
_URL = r"^(?s)(.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` or null: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest listed rule that fits, as struct(rule, verdict), or null: rules are tried from the longest."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """A url's tokens: scheme, labels of the host, segments of the path (a number by its digits), last extension, keys and values of the query, fragment, words of the host.

    A null url has none but the number of words; each token stands once.
    """
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), F.lower(path_of(url))
    query, fragment = F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)), F.lower(F.regexp_extract(url, r"#(.*)$", 1))
    marked = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    found = F.flatten(
        F.array(
            marked("scheme", F.array(F.lower(F.regexp_extract(url, _URL, 1)))),
            marked("host", F.split(host, r"\.")),
            marked("path", F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(r"^\d+(\.[a-z]+)?$"), F.concat(F.lit("digits "), F.length(F.regexp_extract(x, r"^\d+", 0)).cast("string"))).otherwise(x))),
            marked("ext", F.array(F.regexp_extract(path, r"\.([a-z]+)$", 1))),
            marked("query", F.split(query, "&")),
            marked("fragment", F.array(fragment)),
        )
    )
    return F.array_distinct(F.concat(found, F.array(F.concat(F.lit("words:"), F.size(F.split(host, "[.-]")).cast("string")))))


RULE = "rule long, tokens array<string>, anchor string, n long, bad long, confidence double, lift double"


def fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule of every rule whose tokens are all among the items of a row (key, items).

    An inverted index: a rule is filed under its anchor, one of its tokens, and only rules under tokens of
    a row are compared.  A pair comes up once.  The index is broadcast if its measured size allows.
    """
    index = rules.select("rule", "tokens", F.col("anchor").alias("token"))
    posted = rows.select("key", "items", F.explode("items").alias("token")).join(sized(index), "token")
    return posted.where(F.size(F.array_except("tokens", "items")) == 0).select("key", "rule")


def mine(labelled: DataFrame, support: float = SUPPORT, least_urls: int = LEAST_URLS, confidence: float = CONFIDENCE, lift: float = LIFT, least_z: float = LEAST_Z) -> DataFrame:
    """A table of rules (RULE): token combinations whose urls (url, bad: boolean) are bad far more often than others.

    FP-growth over the bad urls finds all combinations that at least ``support`` of the urls and ``least_urls``
    of them hold and are bad; one that reaches this with the label reaches it there.  A rule's confidence is
    then counted over all urls; it must reach ``confidence``, ``lift`` times the share of bad urls, and
    ``least_z`` deviations above it.  Of rules whose tokens contain another rule's, the shorter stays.
    There is no bound on rules or their lengths.  A null label is left out, a null url has no tokens but the
    number of its words, repeated rows count each; without labelled or without bad urls there are no rules.
    Ties of anchors go to the first token by name.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("key"), tokens(F.col("url").cast("string")).alias("items"), "bad")
    rows = written(rows, "url-items")
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).head()
    least = max(support * n, least_urls)
    nothing = spark.createDataFrame([], RULE)
    if not n or bad < least:
        dropped(rows)
        return nothing
    held = rows.select(F.explode("items").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("held"), F.count_if("bad").alias("held_bad"))
    useful = written(held.where((F.col("held_bad") >= least) & (F.col("held") <= MOST_SHARE * n)).select("token", "held"), "url-tokens")
    several = rows.where("bad").select("key", F.explode("items").alias("token")).join(sized(useful.select("token")), "token", "left_semi").groupBy("key").agg(F.collect_set("token").alias("items"))
    common = FPGrowth(itemsCol="items", minSupport=least / bad, minConfidence=1.0).fit(several).freqItemsets
    common = common.where(F.col("freq") >= least)
    found = written(common.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")).withColumn("rule", F.xxhash64("tokens")), "url-sets")
    anchors = found.select("rule", F.explode("tokens").alias("token")).join(sized(useful), "token").groupBy("rule").agg(F.min(F.struct("held", "token")).alias("x")).select("rule", F.col("x.token").alias("anchor"))
    found = written(found.join(anchors, "rule"), "url-sets")
    # A labelled url meets many combinations, so few rows are much work: they are dealt to all tasks.
    counts = fitting(rows.repartition(deals(spark)), found).groupBy("rule").agg(F.count("*").alias("n"))
    base = bad / n
    rules = found.join(counts, "rule").withColumn("confidence", F.col("bad") / F.col("n")).withColumn("lift", F.col("confidence") / base)
    spread = F.sqrt(F.col("n") * base * (1 - base))
    strong = (F.col("confidence") >= confidence) & (F.col("lift") >= lift) & (F.col("bad") - F.col("n") * base >= least_z * spread)
    rules = written(rules.where(strong).selectExpr("rule", "tokens", "anchor", "n", "bad", "confidence", "lift"), "url-strong")
    longer = fitting(rules.select(F.col("rule").alias("key"), F.col("tokens").alias("items")), rules).where("key <> rule").select(F.col("key").alias("rule")).distinct()
    kept = written(rules.join(longer, "rule", "left_anti").selectExpr("rule", "tokens", "anchor", "n", "bad", "confidence", "lift"), "url-rules")
    dropped(rows, useful, found, rules)
    return kept


def judged(pages: DataFrame, mined: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every row: the longest listed rule's verdict, else block if a mined rule fits, else allow.

    Of several mined rules that fit, the first by its text is named.  A null url, or one without ``://``, has
    empty host and path and no listed rule; a url of any length is read whole; null ids and repeated rows
    are judged like any other, equal urls equally; an empty table gives an empty one; other columns are left out.
    """
    rows = pick(pages, page_id="long", url="string").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", listed(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said"))
    if mined is None or mined.isEmpty():
        rows = rows.withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        hits = fitting(rows.where("said is null and url is not null").select(F.col("url").alias("key"), tokens(F.col("url")).alias("items")), mined)
        texts = mined.select("rule", F.array_join("tokens", " & ").alias("text"))
        hits = written(hits.join(sized(texts), "rule").groupBy(F.col("key").alias("url")).agg(F.min("text").alias("hit")), "url-hits")
        rows = rows.join(sized(hits), "url", "left").withColumn("mined_rule", F.when(F.col("said").isNull(), F.col("hit")))
    verdict = F.coalesce("said", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad of pages whose document is labelled: bad is low quality or toxic.

    A page shows the document that the number in its url's path names; a url without one, and a null url,
    is left out.  Conflicting labels of one id count by the worse; null labels count as good, null ids as
    none; a document's pages each give a row; empty tables give an empty one.
    """
    known = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = pick(pages, url="string").withColumn("doc_id", F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:[./]|$)", 1).try_cast("long"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return rows.join(known, "doc_id").select("url", bad.alias("bad"))
