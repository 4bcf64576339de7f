"""URL filters: a rule table first, then a logistic regression on hashed character n-grams.

The n-grams of host and path are made, hashed and weighed by built-in functions and the
JVM's own ML transformers. The model learns from a small table of labelled URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path, meets no
rule and is judged by the model like any other; of rules equally long, the first in
alphabetical order wins; repeated rows are judged alike; an empty table gives an empty one; a
long URL costs time in proportion to its length; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm.support import ascii_lower

#: (verdict, host and path)
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)

#: A labelled table to start from, by label: words common in names of unwanted and of ordinary sites.
UNWANTED = """
https://luckycasino.test/play http://casinobonus.test/en/12 https://www.grandcasino77.test/roulette
https://slots-jackpot.test/spin http://jackpot-city.test/bonus https://roulette-online.test/en/4
http://betting-tips.test/odds https://sportsbets.test/live https://bet365mirror.test/en/2 http://bets4you.test/
https://pokerstar-room.test/deal http://poker-chips.test/fr/8 https://onlinepills.test/order
http://cheappharmacy.test/en/31 https://viagra-shop.test/buy http://cialis-discount.test/de/6
https://cheapmeds24.test/ http://weightloss-pills.test/offer https://pills4less.test/es/2
http://adultcams.test/live https://xxx-videos.test/watch http://www.hotporn.test/tube https://sexcam-chat.test/en/9
http://adult-dating.test/join https://nudegirls.test/gallery http://escort-adult.test/en/1
https://spamhub.test/links http://seospam.test/en/7 https://backlink-farm.test/buy http://linkfarm99.test/a
https://content-farm.test/en/55 http://click-here-ads.test/click?id=1 https://adserver-track.test/pixel
http://tracking-ads.test/en/3 https://popads-network.test/ http://ads-banner.test/show https://adclicks.test/t
https://freemoney-now.test/win http://winbigprize.test/claim https://free-gift-cards.test/en/6
http://free-iphone-win.test/ https://lottery-winner.test/fr/1 http://crypto-doubler.test/invest
https://cheaploans-fast.test/apply http://payday-cash.test/en/8 https://quickcredit-loan.test/es/5
http://crackedsoft.test/keygen https://warez-zone.test/en/4 http://torrent-cracks.test/free
https://download-free-crack.test/ http://replica-watches.test/shop https://cheap-replica-bags.test/en/3
http://fake-diploma.test/order https://essay-cheap.test/buy http://get-followers-cheap.test/en/2
https://miracle-cure.test/secret http://m.bestbets-today.test/en/41 http://blog.casino-news.test/en/77
https://m.freespins.test/de/12 http://shop.cheap-viagra.test/fr/9 https://go.spamclicks.test/en/5
""".split()
ORDINARY = """
https://www.wikipedia-mirror.test/ http://news.dailyherald.test/en/12 https://library.test/books
https://blog.gardening.test/en/9 http://city-museum.test/fr/3 https://weather.test/today
http://open-data.test/x https://schools.test/en/88 https://recipes.test/order http://train-times.test/es/4
https://m.music-archive.test/en/5 http://www.history.test/rome https://science-today.test/ http://health.test/care
https://university.test/courses http://parliament.test/debates https://theatre.test/es/41 http://jobs.test/en/6
https://documentation.test/api http://travel-notes.test/free https://football-results.test/win
http://www.astronomy.test/en/148.html?page=2 https://art-house.test/en/3 http://chess-club.test/game
https://kitchen-garden.test/de/4 http://birdwatching.test/en/2 https://mountain-huts.test/fr/7
http://local-history.test/en/31 https://bicycle-repair.test/es/8 http://blog.carpentry.test/en/2
https://m.photography.test/en/960 http://poems.test/ https://linux-kernel.test/docs http://bakery.test/menu
https://river-water-levels.test/en/14 http://volunteer-fire.test/de/22 https://hospital-info.test/en/6
http://mathematics.test/proof https://language-course.test/es/1 http://old-maps.test/fr/19
https://public-transport.test/en/7 http://geology.test/rocks https://insects.test/en/1 http://orchestra.test/en/5
https://farmers-market.test/de/3 http://harbour-news.test/es/39/ https://www.newspaper.test/en/148.html
http://m.reader-letters.test/fr/11/ https://blog.engineering.test/en/77 http://winter-sports.test/en/9
https://addresses.test/search http://tractor-farm-machines.test/en/8 https://tracks-and-trails.test/en/4
http://clickable-maps.test/de/6 https://freedom-of-press.test/ http://loanwords-dictionary.test/en/13
https://between-rivers.test/fr/2 http://badminton.test/es/7 https://adelaide-weather.test/en/10
http://essex-county.test/council https://alphabet-letters.test/en/2 http://winemakers.test/fr/5
""".split()

GRAMS = (3, 4)
FEATURES = 1 << 15


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """A struct of the longest rule that fits and its verdict, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
                        ).otherwise(chosen)
    return chosen


def grams(host: Column, path: Column) -> Column:
    """All n-grams of both parts, each marked with its part."""

    def of(mark: str, text: Column, n: int) -> Column:
        # A list of characters is read at any place at once; a text is walked from its start.
        chars = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
        none = F.array().cast("array<int>")

        def spread(own: Column) -> Column:
            last = F.size(own) - n
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
            return F.transform(starts, lambda i: F.concat(
                F.lit(f"{mark}{n}"), *(F.get(own, i + k) for k in range(n))))

        return F.flatten(F.transform(chars, spread))

    return F.concat(*[of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in GRAMS])


def with_parts(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path")
                       ).withColumn("grams", grams(F.col("host"), F.col("path")))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled URLs: ``(url, label)``, label 1 for unwanted sites."""
    marked = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(label)).alias("label"))
                       for label, urls in ((1, UNWANTED), (0, ORDINARY)) for u in urls])
    return spark.range(1).select(F.inline(marked))


def trained(labelled: DataFrame, features: int = FEATURES, penalty: float = 0.002) -> PipelineModel:
    """A model of the labelled table; the table is small, a few hundred rows."""
    terms = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    fit = LogisticRegression(regParam=penalty, maxIter=60, labelCol="label")
    rows = with_parts(labelled, "url").select("grams", F.col("row.label").alias("label")).coalesce(1)
    return PipelineModel([terms, fit.fit(terms.transform(rows))])


def judged(urls: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str]] = RULES,
           url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``row`` (a struct of the input), ``host``, ``path``, ``rule``, ``verdict``, ``score``."""
    scored = model.transform(with_parts(urls, url))
    chosen = rule_column(rules, F.col("host"), F.col("path"))
    score = vector_to_array("probability")[1]
    return scored.select("row", "host", "path", chosen.alias("chosen"), score.alias("score")).select(
        "row", "host", "path", F.col("chosen.rule").alias("rule"), F.coalesce(
            F.col("chosen.verdict"),
            F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score")


def op6(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, trained(labelled_table(spark))).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
