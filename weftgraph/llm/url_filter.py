"""URL filter: allow and block rules, and for the rest a logistic regression on hashed character n-grams.

A URL is cut into host (after the first `://`, A-Z lower-cased) and path. A rule names a host and a path prefix; it
fits that host and its subdomains, and the longest fitting rule decides. Every other URL is judged by a
model trained from a small labelled URL table: character n-grams of host and path are hashed into `FEATURES` buckets,
and logistic regression weighs them. All of it runs in the JVM: column expressions and Spark's own feature hashing and
regression; URLs are scored where they are read, without a shuffle.

Null URLs and those without `://` have an empty host and path, fit no rule with a host, and are judged by the model
like any other. Repeated rows are judged alike; an empty table gives an empty result; other columns are kept,
but for input columns named host, path, rule, verdict or block_probability, which give way to the results.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed features, and lengths of the character n-grams.
FEATURES, GRAMS = 1 << 14, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules (verdict, host, path) of the registered query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Words of the small labelled URL table.
BLOCKED_WORDS = "adult ads bets bingo bonus casino cheap click diet dating escort gamble hack jackpot loan lottery malware pharm phish pills poker popup porn prize replica spam slots tracker viagra warez win-cash xxx".split()
ALLOWED_WORDS = "archive article atlas bakery biology bridge castle chess city cinema climate college cooking country culture daily design doctor earth energy forest forum garden gazette geology guide health history home hotel journal kitchen law letters library local magazine market math museum music nature news ocean open paper people physics planet poetry radio recipes review river school science shop society sport station story street student summer theatre tides travel tribune union univers valley village voice water weather wiki winter world".split()
PLACES = ("https://{w}.example.com/{p}/{n}", "http://www.{w}.example.org/{p}/{n}.html", "https://blog.{w}.example.net/{p}/{n}?page=2", "https://m.{w}.example.com/{p}/{n}#top")


def labelled_urls(spark: SparkSession, path: str | None = None, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """The small labelled table: url, blocked (0 or 1), from a CSV file with a header, or else one made of words (some may be left out) and places."""
    if path is not None:
        return spark.read.csv(path, header=True, schema="url string, blocked double")
    rows = [
        (place.format(w=word, p=("en", "fr", "de", "es")[(i + k) % 4], n=37 * i + 11 * k), float(blocked))
        for blocked, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS))
        for i, word in enumerate(words)
        if word not in leave_out
        for k, place in enumerate(PLACES)
    ]
    # rows of two values in the plan: no Python worker reads them
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{url}', {blocked}D)" for url, blocked in rows) + " AS t(url, blocked)")


def host_of(url: Column) -> Column:
    """Lower-cased host; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path after the host; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of the marked host and path, each with the part that it comes from."""

    def of(text: Column, mark: str, n: int) -> Column:
        many = F.length(text) - n + 1
        return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(F.concat(F.lit("."), host, F.lit("/")), "h", n) for n in GRAMS], *[of(path, "p", n) for n in GRAMS])


def train(labelled: DataFrame) -> PipelineModel:
    """Logistic regression from a labelled table (url, blocked)."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(_grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), "blocked")
    steps = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(labelCol="blocked", featuresCol="features", regParam=0.002, maxIter=60, probabilityCol="probability"),
    ]
    held = rows.coalesce(1).cache()
    try:
        return Pipeline(stages=steps).fit(held)
    finally:
        held.unpersist()


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All columns of `pages`, with host, path, rule, verdict and block_probability."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_probability")]
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_keep"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for what, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, at + start) if rule is None else rule.when(fits, at + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    scored = model.transform(df.withColumn("grams", _grams(host, path)))
    chance = vector_to_array(F.col("probability"))[1]
    return scored.select(
        "_keep.*",
        "host",
        "path",
        (rule if rule is not None else F.lit(None).cast("string")).alias("rule"),
        F.coalesce(verdict if verdict is not None else F.lit(None), F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"),
        chance.alias("block_probability"),
    )
