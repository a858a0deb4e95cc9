"""URL filters: rules for hosts and paths first, then logistic regression on hashed character n-grams.

The model learns from a small labelled table of URLs, which labelled_urls() builds by rule from the lists below: hosts and
paths of unwanted pages (gambling, pills, adult, prize and tracking pages) against ordinary ones, each in several forms.
N-grams of host and path are told apart by a prefix and hashed into BUCKETS counts, so the model's size does not depend on the data.
Everything runs in JVM expressions; only the url column is read.

Defined results: a null url or one without `://` has an empty host and path, fits no rule, and has no n-grams: the model's intercept
decides, which the labelled table's empty URL (allow) is part of. Rows that repeat are judged alike; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host and, from its first slash on, the start of a path
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SIZES = (3, 4, 5)
BUCKETS = 1 << 15

BAD_HOSTS = (
    "casino", "roulette-club", "jackpot", "poker-bonus", "slots", "betting", "free-money", "pillshop", "viagra", "pharma-deal",
    "xxx", "porn", "adult-cams", "sexdates", "escort", "win-prize", "lottery", "clickbait", "adtrack", "popup-ads",
    "warez", "torrent-crack", "fast-loans", "crypto-double", "bulk-mailer", "seo-ring",
)
GOOD_HOSTS = (
    "news", "library", "school", "university", "museum", "weather", "recipes", "garden", "travel-notes", "history",
    "science", "docs", "wiki", "health-service", "city-council", "music", "sports-club", "bookshop", "blog", "forum",
    "research", "parks", "theatre", "journal",
)
BAD_PATHS = ("/bonus/spin", "/free-win/now", "/buy/pills-online", "/adult/cams/live", "/click/track?id=1", "/prize/claim")
GOOD_PATHS = ("/en/1204", "/articles/2019/spring.html", "/about", "/fr/88/", "/docs/guide/index.html", "/de/topics/history")
FORMS = ("https://{host}.test{path}", "http://www.{host}.invalid{path}", "http://m.{host}.test:8080{path}", "https://{host}.localhost{path}")
#: ordinary hosts with names that mean nothing, as many hosts have: three of these each
SYLLABLES = ("ba", "ko", "lu", "mi", "ne", "po", "ra", "sa", "tu", "vi", "wo", "ze", "fa", "du")

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1.0: block). Some ordinary hosts have invented names, as hosts have."""
    rows = [("", 0.0)]
    for k in range(104):
        good = GOOD_HOSTS[k % 24] if k % 2 else "".join(SYLLABLES[(k * m + m) % 14] for m in (1, 3, 5))
        # a path of ordinary pages comes as often per ordinary page as per unwanted one that has such a path
        rows.append((FORMS[(k + k // 4) % 4].format(host=good, path=GOOD_PATHS[(k // 2 + k // 12) % 6]), 0.0))
        rows.append((FORMS[(k + k // 4) % 4].format(host=BAD_HOSTS[k % 26], path=(BAD_PATHS if k % 3 else GOOD_PATHS)[(k // 3 + k // 18) % 6]), 1.0))
    return spark.createDataFrame(rows, "url string, label double")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), *LETTERS)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        of, _, start = rule.partition("/")
        fits = ((host_ == of) | host_.endswith("." + of)) & path_.startswith("/" + start)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def grams(host_: Column, path_: Column) -> Column:
    """Character n-grams of host and path, with marks at their ends."""

    def of(text: Column, prefix: str, n: int) -> Column:
        def cut(chars: Column) -> Column:  # from an array of characters, so that a long text takes linear time
            at = F.sequence(F.lit(0), F.size(chars) - n)
            return F.transform(at, lambda i: F.concat(F.lit(prefix), *[F.get(chars, i + k) for k in range(n)]))

        chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
        long_enough = (F.char_length(text) > 0) & (F.char_length(text) + 2 >= n)
        return F.when(long_enough, F.get(F.transform(F.array(chars), lambda c: cut(c)), F.lit(0))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(F.translate(t, *LETTERS), p, n) for t, p in ((host_, "h:"), (path_, "p:")) for n in SIZES])


def _hashing():
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)


def featured(df: DataFrame) -> DataFrame:
    """df(url) with host, path, grams and features."""
    split = df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    return _hashing().transform(split.withColumn("grams", grams(F.col("host"), F.col("path"))))


def fit(labelled: DataFrame):
    """The model of a small labelled table (url, label)."""
    from pyspark.ml.classification import LogisticRegression

    table = featured(labelled).select("features", "label").coalesce(1).cache()
    model = LogisticRegression(maxIter=30, regParam=0.1).fit(table)
    table.unpersist()
    return model


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) for every row of pages(page_id, url)."""
    from pyspark.ml.functions import vector_to_array

    model = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    scored = model.transform(featured(pages.select("page_id", "url")))
    scored = scored.withColumn("score", vector_to_array("probability")[1]).withColumn("fits", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")
