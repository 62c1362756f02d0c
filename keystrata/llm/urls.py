"""URL filter: host rules first, then logistic regression on hashed character n-grams.

Features are the 3-character strings of host and path, each with its own end marks, hashed
by a polynomial of their code points to DIMENSIONS buckets. The model is fitted once on the
driver from URL_LABELS below, by plain gradient descent, and its weights are rounded to
whole thousandths, so that scores are exact sums of integers on any engine. Scoring is one
DataFrame expression without a shuffle.

Rows: a null URL, or one without `://`, has an empty host and path, fits no rule and gets
the model's bias for a score. Repeated rows are judged alike, long URLs whole, in a time
that grows with their length; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import read

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DIMENSIONS = 2048
SCALE = 1000
STEPS, RATE, PENALTY = 300, 0.5, 0.001
#: Host, path and whether to block: a small table made for this filter.
URL_LABELS = (
    ("www.daily-courier.example", "/news/2021/04/city-council-vote", 0),
    ("news.harbour-times.example", "/world/article-10482", 0),
    ("en.openlexikon.example", "/wiki/Photosynthesis", 0),
    ("de.openlexikon.example", "/wiki/Fotosynthese", 0),
    ("docs.tidyparser.example", "/en/latest/tutorial.html", 0),
    ("blog.gardenkeeper.example", "/en/2019/planting-beans/", 0),
    ("www.university-of-north.example", "/departments/physics/staff", 0),
    ("library.townhall.example", "/catalogue/item/55120", 0),
    ("m.weatherwatch.example", "/fr/previsions/lyon", 0),
    ("forum.bikefixers.example", "/thread/8821/chain-noise", 0),
    ("www.museumofmaps.example", "/exhibitions/old-atlases", 0),
    ("recipes.slowkitchen.example", "/es/sopa-de-lentejas", 0),
    ("www.healthservice.example", "/advice/sleep", 0),
    ("code.smallforge.example", "/project/readme", 0),
    ("journal.seastudies.example", "/volume/12/issue/3", 0),
    ("www.cityparks.example", "/de/oeffnungszeiten", 0),
    ("static.textarchive.example", "/books/1880/chapter-07.html", 0),
    ("answers.mathcircle.example", "/questions/3310", 0),
    ("www.trainlines.example", "/en/timetable", 0),
    ("radio.valley.example", "/programme/archive", 0),
    ("shop.handbound.example", "/en/notebooks/17", 0),
    ("blog.nightsky.example", "/fr/eclipse-de-lune", 0),
    ("www.parliament-records.example", "/debates/1999-03-02", 0),
    ("m.football-results.example", "/en/league/table", 0),
    ("best-casino-bonus.example", "/free-spins/slots-jackpot", 1),
    ("www.mega-casino777.example", "/win/bonus-now", 1),
    ("poker-slots-online.example", "/jackpot", 1),
    ("xxx-hot-cams.example", "/live/sex-video", 1),
    ("freeporn-tube.example", "/xxx/videos/8812", 1),
    ("adult-sex-dating.example", "/hot/singles", 1),
    ("cheap-viagra-pills.example", "/buy-viagra-online", 1),
    ("buy-cheap-pills-rx.example", "/pharmacy/no-prescription", 1),
    ("www.online-pharmacy-rx.example", "/cialis-viagra-discount", 1),
    ("free-iphone-winner.example", "/claim-prize-now", 1),
    ("click4cash-money.example", "/get-rich-fast", 1),
    ("payday-loans-fast-cash.example", "/apply-now-bonus", 1),
    ("crypto-doubler-free.example", "/get-free-coins", 1),
    ("warez-crack-keygen.example", "/download/serial-keys", 1),
    ("torrent-cracked-games.example", "/free-download-crack", 1),
    ("replica-watches-cheap.example", "/buy-now-discount", 1),
    ("seo-backlinks-cheap.example", "/buy-backlinks", 1),
    ("hot-singles-xxx.example", "/chat-sex-cams", 1),
    ("lottery-winner-prize.example", "/claim-jackpot", 1),
    ("cheap-essay-writers.example", "/buy-essay-discount", 1),
    ("casino-pharmacy-links.example", "/xxx-poker-pills", 1),
    ("www.bonus-slots-free.example", "/casino/win-cash", 1),
    ("free-money-click.example", "/prize-winner-bonus", 1),
    ("viagra-casino-porn.example", "/cheap-free-xxx", 1),
)


def marked(host: str, path: str) -> str:
    return f"<{host}>{path}|"


def buckets(text: str) -> list[int]:
    c = [ord(x) for x in text]
    return [(a * 40503 + b * 9973 + d * 131) % DIMENSIONS for a, b, d in zip(c, c[1:], c[2:], strict=False)]


@cache
def model() -> tuple[int, tuple[int, ...]]:
    """Bias and weights in 1/SCALE, from URL_LABELS. A URL's features count 1 / sqrt of how
    many it has in the fit and the verdict is by the plain sum's sign against the bias."""
    rows = [(buckets(marked(h, p)), y) for h, p, y in URL_LABELS]
    w, bias = [0.0] * DIMENSIONS, 0.0
    for _ in range(STEPS):
        grad, gbias = [PENALTY * x for x in w], 0.0
        for fs, y in rows:
            z = bias + sum(w[f] for f in fs) / len(fs) * 8
            e = (1 / (1 + math.exp(-z)) - y) / len(rows)
            gbias += e
            for f in fs:
                grad[f] += e * 8 / len(fs)
        w = [a - RATE * 8 * g for a, g in zip(w, grad, strict=True)]
        bias -= RATE * gbias
    return round(bias * SCALE), tuple(round(x * 8 * SCALE) for x in w)


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path expressions of a URL column."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def ruled(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule of the columns host and path, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def score() -> Column:
    """The model's sum for the columns host and path, as bias + mean weight, in integers:
    bias * n + sum of weights, whose sign is the verdict's. One pass over the characters."""
    bias, w = model()
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>")
    text = F.concat(F.lit("<"), F.col("host"), F.lit(">"), F.col("path"), F.lit("|"))
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("bigint"))
    n = F.length(text) - 2
    # the second and third characters begin at the first one's next places
    grams = F.zip_with(F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * 40503 + b * 9973), F.slice(codes, 3, n), lambda x, d: (x + d * 131) % DIMENSIONS)
    return F.aggregate(grams, F.lit(0).cast("bigint"), lambda s, g: s + F.lit(bias) + F.get(table, g.cast("int")))


def filtered(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, score and verdict."""
    host, path = parts(url)
    d = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = ruled()
    d = d.select("*", rule.alias("rule"), verdict.alias("_by_rule"), F.when(F.length("host") + F.length("path") > 0, score()).otherwise(F.lit(model()[0])).alias("score"))
    return d.withColumn("verdict", F.coalesce("_by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))).drop("_by_rule")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def oracle() -> str:
    bias, w = model()
    whens = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, '<' || host || '>' || path || '|' AS marked, CASE
{whens} ELSE NULL END AS hit FROM p),
s AS (SELECT *, CASE WHEN length(host) + length(path) = 0 THEN {bias} ELSE CAST(list_sum(list_transform(generate_series(1, length(marked) - 2), lambda i:
  {bias} + w[(unicode(substr(marked, i, 1))::BIGINT * 40503 + unicode(substr(marked, i + 1, 1)) * 9973 + unicode(substr(marked, i + 2, 1)) * 131) % {DIMENSIONS} + 1])) AS BIGINT) END AS score
  FROM t, (SELECT {list(w)} AS w))
SELECT page_id, host, path, split_part(hit, '|', 2) AS rule, coalesce(split_part(hit, '|', 1), CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score::BIGINT AS score FROM s"""
