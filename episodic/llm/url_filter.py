"""URL filter: rules by host and path first, else logistic regression on hashed character n-grams.

The classifier learns from a small labelled table of URLs (``LABELLED`` by default, at most
``MOST_LABELLED`` rows).  With so few examples the weights are a combination of the examples, so
gradient descent runs on one coefficient an example: the table of common n-grams of any two
examples comes from one join on buckets, the descent is one fold over that small matrix, and the
weights follow by a sum over buckets.  Scoring is a projection: every URL looks up its n-grams in
one array of ``BUCKETS`` weights.  Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.llm.common import table, written

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
MOST_LABELLED = 500

#: (verdict, host, path) of rules, as in the contract of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled URLs: 1 is to be blocked.
LABELLED = [
    *[(1, u) for u in (
        "http://casino-royal.test/en/12", "https://www.best-casino.test/de/4410", "http://online-poker.test/play?id=3",
        "http://win-big.test/fr/830/", "https://blog.casino-wins.test/en/77.html", "http://sport-bets.test/es/99#top",
        "https://www.free-bet.test/en/1", "http://freebets24.test/fr/5120", "http://m.betting-free.test/de/31/",
        "https://cheap-meds.test/en/200", "http://www.pills-online.test/de/91", "http://buy-pills.test/en/640?page=2",
        "https://m.cheapviagra.test/fr/18", "http://cheap-watches.test/es/712.html", "https://adult-video.test/en/35",
        "http://www.adult-chat.test/fr/606", "http://xxx-adult.test/en/9/", "https://m.sexy-x.test/de/2001",
        "https://ads-server.test/en/41", "http://www.ad-track.test/de/870?ref=x", "http://click-ads.test/fr/3",
        "https://tracking-pixel.test/es/19", "http://blog.trackers.test/en/5501#top", "http://spam-mail.test/en/66",
        "https://www.link-farm.test/de/420", "http://linkfarm.test/en/1834/", "https://spammy-links.test/fr/7",
        "http://m.content-farm.test/es/290", "https://get-rich-fast.test/en/12", "http://fast-loans.test/de/811",
        "https://www.free-money.test/en/950", "http://lottery-win.test/fr/44", "http://free-gift-card.test/en/1?utm_source=feed",
        "https://www.download-crack.test/es/68", "http://keygen-free.test/de/15/", "https://hot-girls.test/en/23")],
    *[(0, u) for u in (
        "http://library.test/en/12", "https://www.cityhall.test/de/4410", "http://museum.test/visit?id=3",
        "http://weather.test/fr/830/", "https://blog.gardening.test/en/77.html", "http://university.test/es/99#top",
        "https://www.newspaper.test/en/1", "http://physics-dept.test/fr/5120", "http://m.recipes.test/de/31/",
        "https://open-maps.test/en/200", "http://www.history-notes.test/de/91", "http://mathematics.test/en/640?page=2",
        "https://m.railways.test/fr/18", "http://theatre.test/es/712.html", "https://hospital.test/en/35",
        "http://www.teachers.test/fr/606", "http://other-shore.test/en/9/", "https://m.thinking.test/de/2001",
        "https://national-archive.test/en/41", "http://www.orchestra.test/de/870?ref=x", "http://botany.test/fr/3",
        "https://translation.test/es/19", "http://blog.weaving.test/en/5501#top", "http://northern-lights.test/en/66",
        "https://www.there-and-then.test/de/420", "http://astronomy.test/en/1834/", "https://stationery.test/fr/7",
        "http://m.chess-club.test/es/290", "https://bicycle-repair.test/en/12", "http://mountain-hut.test/de/811",
        "https://www.handbook.test/en/950", "http://poetry.test/fr/44", "http://the-ledger.test/en/1?utm_source=feed",
        "https://www.harbour.test/es/68", "http://ringing-bells.test/de/15/", "https://thermal-baths.test/en/23")],
]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null.  A rule fits its host, all its
    subdomains, and the paths that start with its path.  Of equally long rules the one with the
    longer host wins, then the first by text."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def ngrams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the character n-grams of host and path, and the bucket 0 of the bias."""
    def grams(tag: str, text: Column, n: int) -> Column:
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: (F.pmod(F.xxhash64(F.concat(F.lit(tag), F.substring(text, i, F.lit(n)))), F.lit(buckets - 1)) + 1).cast("int"))

    texts = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), F.lower(path), F.lit("$"))}
    parts = [grams(tag, text, n) for tag, text in texts.items() for n in SIZES]
    return F.array_distinct(F.concat(F.array(F.lit(0)), *parts))


def weights(labelled: DataFrame, buckets: int = BUCKETS, epochs: int = 300, rate: float = 0.02, l2: float = 0.2) -> DataFrame:
    """One row, ``w``: the weights of all buckets, from ``labelled`` (label 0/1, url).

    Rows with a null label or url are left out, repeated rows count once.  Without any row all
    weights are 0.  More than ``MOST_LABELLED`` rows are refused: this is for small tables.
    """
    rows = labelled.where("label IS NOT NULL AND url IS NOT NULL").select(F.col("label").cast("double").alias("y"), "url").distinct()
    rows = written(rows.withColumn("x", ngrams(host_of(F.col("url")), path_of(F.col("url")), buckets)))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    long = rows.select("url", F.explode("x").alias("b"))
    common = long.join(long.select(F.col("url").alias("other"), "b"), "b").groupBy("url", "other").agg(F.count(F.lit(1)).cast("double").alias("k"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("other", "k"))), lambda e: e["k"])
    # every two examples share the bias bucket, so no pair is missing in ``common``
    matrix = common.groupBy("url").agg(line.alias("k")).join(rows.select("url", "y"), "url")
    # at most MOST_LABELLED rows of as many numbers
    one = matrix.agg(F.sort_array(F.collect_list(F.struct("url", "y", "k"))).alias("m"))

    def step(a: Column, _: Column) -> Column:
        def new(row: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(row["k"], a, lambda k, v: k * v), F.lit(0.0), lambda s, v: s + v)
            return F.get(a, i) * (1 - rate * l2) + rate * (row["y"] - 1 / (1 + F.exp(-margin)))

        return F.transform(F.col("m"), new)

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.transform("m", lambda _: F.lit(0.0)), step)
    alpha = one.select(F.explode(F.arrays_zip(F.col("m.url").alias("url"), fold.alias("a"))).alias("e")).select("e.url", "e.a")
    by = long.join(alpha, "url").groupBy("b").agg(F.sum("a").alias("w"))
    every = labelled.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b")).join(by, "b", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda e: e["w"]).alias("w"))


def labelled_table(spark: SparkSession, rows: list[tuple[int, str]] | None = None) -> DataFrame:
    chosen = LABELLED if rows is None else rows
    each = [F.struct(F.lit(label).cast("int").alias("label"), F.lit(url).alias("url")) for label, url in chosen]
    return spark.range(1).select(F.inline(F.array(*each))) if each else spark.range(0).selectExpr("int(id) AS label", "string(id) AS url")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.75,
          url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (columns of these names are replaced).

    A page without a rule is blocked from a score of ``threshold`` on.  A null url has an empty host and path and is judged like any other.  Empty pages give no rows.
    """
    spark = pages.sparkSession
    w = written(weights(labelled_table(spark) if labelled is None else labelled))
    url = F.col(f"`{url_col}`").cast("string")
    known = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    known = known.withColumns({"_w": w.scalar(), "_x": ngrams(F.col("host"), F.col("path")), "_r": rule_of(F.col("host"), F.col("path"), rules)})
    margin = F.aggregate("_x", F.lit(0.0), lambda s, b: s + F.coalesce(F.get(F.col("_w"), b), F.lit(0.0)))
    known = known.withColumn("score", 1 / (1 + F.exp(-margin)))
    return known.withColumns({"rule": F.col("_r.rule"), "verdict": F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))}).drop("_w", "_x", "_r")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
