"""URL filters: rules of host and path, and gradient-boosted trees for what no rule decides.

The trees judge what a URL looks like: its length, the depth of its path, the share of digits, the
entropy of its characters, the number of parameters, and how the suffixes of its host stand in the
labelled URLs. All features are DataFrame functions; fitting and scoring are Spark's own trees, in
the JVM. The model comes from labelled URLs alone, so a verdict depends on the URL and not on the
other rows of the table, and nothing is shuffled to judge it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import lower_ascii

ALLOW, BLOCK = "allow", "block"

FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "host_labels",
    "host_digit_share",
    "digit_share",
    "mark_share",
    "host_hyphens",
    "longest_host_run",
    "host_entropy",
    "url_entropy",
    "parameters",
    "query_share",
    "suffix_unwanted",
    "suffix_common",
)

# Labelled URLs are a small table; a larger one is refused.
MOST_LABELLED = 100_000
# Suffixes with statistics of their own, the most frequent ones among the labelled URLs.
MOST_SUFFIXES = 50
# URLs of invented sites that are plainly ordinary or plainly not wanted. Both kinds
# use the same suffixes, so that a suffix alone does not decide.
ORDINARY = (
    "https://www.riverside-library.org/catalogue/history/1904",
    "https://meadowschool.org/parents/term-dates",
    "https://news.harbourtimes.com/2021/05/harvest-festival",
    "https://www.oakbakery.com/recipes/rye-bread.html",
    "http://museum.northvale.org/exhibits/ceramics",
    "https://docs.plainparser.net/en/latest/tutorial.html",
    "https://blog.gardenpath.net/en/2019/pruning-roses",
    "https://weather.coastline.net/forecast/today",
    "https://www.cityarchive.org/letters/page/12",
    "https://forum.bikeworkshop.com/topic/4821",
    "https://en.fieldguide.org/birds/robin",
    "https://shop.papermill.com/notebooks/a5",
    "https://www.stonebridge.com/about",
    "https://mountainhut.net/en/routes/17",
    "https://wiki.openworkbench.org/index.php?title=Lathe",
    "https://www.lakesidechoir.org/concerts/2022#autumn",
    "https://science.valeuniversity.org/papers/6120.html",
    "https://cookbook.applegate.net/de/1183/",
    "https://m.eveningpost.com/fr/4410",
    "https://www.eveningpost.com/fr/4410?page=2",
    "http://blog.windmill.com/es/903#top",
    "http://clockmaker.org/repairs/faq",
    "https://maps.townhall.net/parking",
    "https://www.townhall.net/council/minutes/2020",
    "https://photos.hillwalkers.org/album/88",
    "https://www.hillwalkers.org/en/2071?utm_source=feed",
    "https://translate.wordhoard.net/en/7702/",
    "https://wordhoard.net/fr/5519.html",
    "https://research.seedbank.org/de/3316?page=3&ref=x",
    "https://blog.seedbank.org/es/64",
    "https://theatre.oldmarket.com/programme",
    "https://radio.oldmarket.com/schedule/monday",
    "https://www.north-abbey.org/guided-tours",
    "https://saint-mary-hospital.net/en/departments",
    "https://books.lantern.net/en/8054#top",
    "https://www.lantern.net/authors/m",
    "https://lantern.net/en/120/",
    "https://www.weavers.org/patterns/twill.html",
    "http://www.fishmarket.com/en/5233",
    "https://m.fishmarket.com/de/9871?utm_source=feed",
    "https://potterystudio.net/fr/2450/",
    "http://m.potterystudio.net/classes/evening",
    "https://www.villagehall.org/en/377.html",
    "https://villagehall.org/bookings?month=6",
    "https://blog.brickyard.com/de/7718#top",
    "https://brickyard.com/en/66?page=4&ref=x",
    "https://www.quietgarden.org/es/1507",
    "https://health.quietgarden.org/advice/sleep",
    "https://trains.timetable.net/lines/north",
    "https://www.timetable.net/en/9410/",
    "https://press.sailmaker.com/releases/2018",
    "https://sailmaker.com/fr/31.html",
    "https://www.west-coast-rowing.org/fixtures/2023/spring",
    "https://blog.tea-garden.com/how-to-brew/green-tea",
    "https://www.stone-age.net/exhibition/tools",
    "https://astro-club.org/en/3110/",
    "https://en.small-press.org/titles/poems.html",
    "https://www.hillfarm.com/2022/11/14/first-frost-of-the-year",
    "https://daily.marketsquare.net/2020/03/02/council-votes",
    "https://area51museum.org/tickets",
    "https://studio54prints.com/gallery?page=2",
    "https://www.route66diner.com/menu",
    "https://arxiv.paperstack.org/abs/2101.00123",
    "https://code.toolshed.net/projects/plough/issues/482",
    "https://www.dictionaryroom.org/search?q=anvil&lang=en",
    "https://tickets.grandhall.com/book?show=1204&seats=2&date=2021-06-01",
    "https://lists.sundial.net/archive/2017-August/0091.html",
    "https://data.rivergauge.org/stations/00417/levels.csv",
    "https://video.lecturehall.net/watch?v=Zk3f9QmT",
    "https://www.recipesatlas.com/soups-and-stews/leek-and-potato",
    "https://kindergarten.plumtree.org/fr/77",
    "https://sports.plumtree.com/results/2019/round-3",
)
UNWANTED = (
    "http://win-big-casino-4711.com/bonus/?aff=88123&sub=a91f&click=7731",
    "http://www.cheap-meds-247.net/order.php?id=99812&promo=50off&ref=xx91",
    "https://free-cash-now.org/claim?uid=8842771&token=9fe3a1c77d&step=2",
    "http://x8d2k9q1z.com/a/b/c/d/e/f/index.php?s=81&t=22&u=91&v=3",
    "http://best-replica-watches-00.com/buy/1/2/3/4/5/6/7.html",
    "http://hot-singles-8855.net/join/now/?src=1&cmp=22&kw=33&pos=4",
    "https://login-verify-account-6612.com/secure/8821/confirm?session=99a8b7c6d5e4",
    "http://adult-cams-live.net/view?model=18273&aff=2211",
    "http://casino-slots-777.org/spin/?bonus=777&lucky=7",
    "http://pills-no-script.com/en/2214",
    "https://www.mega-poker.net/es/501/",
    "http://m.adult-zone.org/fr/8110#top",
    "https://blog.quick-loan.com/de/4411?utm_source=feed",
    "http://quick-loan-365.com/apply?amount=5000&days=30&src=77&id=120",
    "http://xn--77zq19-pay.net/wallet/8f7a6b5c4d3e2f1a0b9c",
    "http://download-crack-serial.com/keygen/2019/setup9921.exe?dl=1&key=77a1",
    "https://www.bet-win-now.com/en/77?page=1&ref=x",
    "http://cheap-tabs.org/en/9034.html",
    "http://blog.casino-royal.net/en/731/",
    "http://sexy-chat-24.com/rooms/1/?a=1&b=2&c=3&d=4&e=5",
    "http://q7w8e9r0t1.net/xx/91/82/73/64/55?z=1029384756",
    "http://a1b2c3d4e5f6.org/redirect?to=88f7e6d5c4b3a291&n=12",
    "https://win-free-phone.net/survey/step3?uid=11223344&cc=us",
    "http://weight-loss-miracle-30.com/offer/?p=39&d=30&x=551",
    "http://work-home-rich.org/signup?ref=9912&lvl=4",
    "https://m.lotto-jackpot.net/en/6555#top",
    "http://www.lotto-jackpot.net/fr/1043",
    "http://buy-followers-fast.com/pack/10000/?pay=btc&coupon=99",
    "http://cheap-viagro-shop.net/item.php?cat=3&id=771&lang=en&cur=usd",
    "http://adult-dating.com/es/318?page=2&ref=x",
    "http://www.poker-chips.org/de/7710#top",
    "https://crypto-double-100x.com/invest?usd=100&wallet=1a2b3c4d5e6f",
    "http://0x91af33.net/d/77182/99271/10029/41.php",
    "http://free-movie-stream-hd.net/watch/8812/server2?ad=1&pop=2&u=9",
    "https://essay-writer.com/order?pages=9&days=1&disc=15",
    "http://blog.adult-zone.org/en/5648/",
    "https://secure-bank-update-11.net/login.php?cmd=_run&dispatch=5885d80a13c0",
    "http://casino-bonus-win.com/en/2855",
    "http://m.pills-rx.net/en/4591?utm_source=feed",
    "https://pills-rx.net/es/5565/",
    "http://seo-rank-boost-1.org/links/81/72/63/54/45/36",
    "http://www.sexy-cams.org/en/463.html",
    "http://win-prize.net/en/120/",
    "http://k2j3h4g5.com/?q=1&w=2&e=3&r=4&t=5&y=6&u=7",
    "https://gift-card-gen-99.com/get?val=100&n=8871&h=ab12cd34",
    "http://loan-payday-1hr.net/fr/2450/",
    "http://hot-deal-x-88.org/de/9871?utm_source=feed",
    "http://torrent-free-4u.com/get/9a8b7c6d/5e4f3a2b/1c0d",
    "http://www.slot-max.com/es/903#top",
    "http://x-rated-clip-7.net/v/77123?autoplay=1&ref=0081",
    "http://z9y8x7w6v5.com/1/2/3/4/5?x=91827364",
    "http://m4n5b6v7c8.org/go.php?id=77120&k=8fa1",
    "http://8f3e2d1c.net/9918/2271/0038/pay.html",
    "http://qxzvkwjh7.com/?c=12&s=99&p=4&r=1",
    "http://r3d1r3ct.net/out?u=aGVsbG8&n=8821&t=99",
    "http://77bet88win.com/en/reg?ref=0912",
    "http://pill4u2day.net/rx/100mg/30/?cur=usd&aff=12",
    "http://cash4free99.org/claim/8812/step/3",
    "http://xxvid247.com/clip/99213/?ad=4",
    "http://lucky888slots.net/spin?bonus=200&code=WIN",
    "http://cheap-flights-now.com/deal?id=1&src=9",
    "http://ad-clicks.net/en/551#top",
    "http://bulk-mails.org/fr/2290/",
    "http://fast-money.com/de/71.html",
    "http://diet-pills.com/es/8112?page=2&ref=x",
    "http://fake-bags.net/en/4410",
    "http://hot-dates.com/en/9021/",
    "http://keno-bets.org/en/338.html",
    "http://link-swap.com/fr/7120?utm_source=feed",
    "http://click-bait.net/es/6021",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path begins with the rule's."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        below = (host == self.host) | host.endswith(f".{self.host}")
        return below & path.startswith(self.path)


@dataclass(frozen=True)
class Model:
    """Fitted trees, and how many labelled URLs of each suffix are unwanted, and how many there are."""

    trees: GBTClassificationModel
    suffixes: dict[str, tuple[int, int]]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one, or without a URL."""
    place = F.locate("://", url)
    return F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def entropy(text: Column) -> Column:
    """Bits a character, from the lengths of the runs of the sorted characters; 0 without text."""
    total = F.length(text).cast("double")

    def bits(run: Column) -> Column:
        return F.when(run > 0, run / total * F.log2(total / run)).otherwise(F.lit(0.0))

    def step(state: Column, letter: Column) -> Column:
        same = state["letter"] == letter
        return F.struct(
            letter.alias("letter"),
            F.when(same, state["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["bits"])
            .otherwise(state["bits"] + bits(state["run"]))
            .alias("bits"),
        )

    none = F.struct(
        F.lit("").alias("letter"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits")
    )
    letters = F.array_sort(F.array_remove(F.split(text, ""), ""))
    return F.aggregate(letters, none, step, lambda last: last["bits"] + bits(last["run"]))


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


def _suffix_statistics(
    suffix: Column, suffixes: dict[str, tuple[int, int]]
) -> tuple[Column, Column]:
    """Smoothed share of unwanted ones, and of all labelled URLs, that have a host's suffix.

    Whole suffixes only: the share of a single domain would give a labelled URL its own label.
    """
    total = sum(number for _, number in suffixes.values())
    unwanted, common = F.lit(0.5), F.lit(0.0)
    for name, (bad, number) in sorted(suffixes.items()):
        here = suffix == name
        unwanted = F.when(here, (bad + 1) / (number + 2)).otherwise(unwanted)
        common = F.when(here, number / total).otherwise(common)
    return unwanted, common


def with_features(
    urls: DataFrame, url_col: str, suffixes: dict[str, tuple[int, int]]
) -> DataFrame:
    """The URL's features as columns. A null URL counts as an empty one."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    runs = F.transform(F.split(host, r"[.\-]"), F.length)
    values = (
        F.length(url),
        F.length(host),
        F.length(path),
        F.size(F.array_remove(F.split(path, "/"), "")),
        F.size(F.array_remove(F.split(host, r"\."), "")),
        _share(F.regexp_count(host, F.lit("[0-9]")), F.length(host)),
        _share(F.regexp_count(url, F.lit("[0-9]")), F.length(url)),
        _share(F.regexp_count(url, F.lit("[^A-Za-z0-9]")), F.length(url)),
        F.regexp_count(host, F.lit("-")),
        F.array_max(runs),
        entropy(host),
        entropy(url),
        F.size(F.array_remove(F.split(query, "&"), "")),
        _share(F.length(query), F.length(url)),
        *_suffix_statistics(suffix_of(host), suffixes),
    )
    return urls.withColumns(
        {name: value.cast("double") for name, value in zip(FEATURES, values, strict=True)}
    )


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The bundled labelled URLs: ``url`` and ``unwanted`` (0 or 1)."""
    rows = [(url, 0) for url in ORDINARY] + [(url, 1) for url in UNWANTED]
    return spark.createDataFrame(rows, "url string, unwanted int")


def _vector(urls: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(urls)


def fit(
    labelled: DataFrame,
    *,
    trees: int = 30,
    depth: int = 2,
    most: int = MOST_LABELLED,
    most_suffixes: int = MOST_SUFFIXES,
) -> Model:
    """Trees of labelled URLs (``url``, ``unwanted``), at most ``most`` rows of them.

    Rows with a null label are left out, repeated ones count as often as they stand there. Both
    labels are needed. The rows are put in one order before they are fitted, so the model does not
    depend on how the table is partitioned.
    """
    rows = labelled.where(F.col("unwanted").isNotNull()).select(
        F.coalesce(F.col("url"), F.lit("")).alias("url"), F.col("unwanted").cast("int")
    )
    found = {row.unwanted: row["count"] for row in rows.groupBy("unwanted").count().collect()}
    if set(found) != {0, 1} or sum(found.values()) > most:
        raise ValueError(f"labels 0 and 1 are needed, on at most {most} rows; found {found}")
    counted = rows.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(
        F.sum("unwanted").alias("bad"), F.count("*").alias("number")
    )
    common = counted.orderBy(F.desc("number"), "suffix").limit(most_suffixes)
    suffixes = {row.suffix: (int(row.bad), row.number) for row in common.collect()}
    # At most ``most`` rows: one partition, in one order.
    ordered = rows.coalesce(1).sortWithinPartitions("url", "unwanted")
    featured = with_features(ordered, "url", suffixes)
    learner = GBTClassifier(
        labelCol="unwanted", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=13,
        cacheNodeIds=False, checkpointInterval=-1,
    )
    return Model(learner.fit(_vector(featured)), suffixes)


def score(urls: DataFrame, model: Model, *, url_col: str = "url") -> DataFrame:
    """The table with a column ``unwanted_score``, from 0 to 1, by the trees alone.

    A null URL is scored as an empty one. All columns stay; none may have the names of the
    features, or of ``unwanted_score``, which ``judge`` sees to.
    """
    scored = model.trees.transform(
        _vector(with_features(urls, url_col, model.suffixes))
    )
    likely = vector_to_array(F.col("probability"))[1].alias("unwanted_score")
    return scored.select(*urls.columns, likely)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    model: Model,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """Verdict on every URL: the id, ``host``, ``path``, ``rule``, ``verdict``, ``unwanted_score``.

    The longest rule that fits decides, equal lengths by text; where none fits, ``rule`` is null and
    the trees decide. A null URL, or one without ``://``, has an empty host and path and is judged
    by the trees. Very long URLs are judged whole. Rows are judged one by one, so repeated rows and
    null or repeated ids stay as they are; other columns are not read.
    """
    read = pages.select(
        F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("_url")
    )
    scored = score(read, model, url_col="_url").select(
        id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        "unwanted_score",
    )
    rule = verdict = None
    for one in sorted(rules, key=lambda one: (-len(one.text), one.text)):
        fits = one.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, one.text) if rule is None else rule.when(fits, one.text)
        verdict = F.when(fits, one.verdict) if verdict is None else verdict.when(fits, one.verdict)
    learnt = F.when(F.col("unwanted_score") >= threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        id_col,
        "host",
        "path",
        (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
        (learnt if verdict is None else verdict.otherwise(learnt)).alias("verdict"),
        "unwanted_score",
    )
