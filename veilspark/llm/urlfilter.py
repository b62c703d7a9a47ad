"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Both training and scoring are SQL expressions. The labelled table is small by
contract (``MOST_LABELLED`` rows, checked), so its gradient steps run as one fold
over one row of gathered features; scoring is a sum of weights looked up per n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS, GRAMS, STEPS, RATE, RIDGE = 2048, (3, 4), 60, 4.0, 0.001
MOST_LABELLED = 1000

# The rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The labelled URLs of training (blocked ones, then allowed ones).
BLOCKED = """
https://casino-bonus.example.org/win/free-spins
http://royal-casino.example.net/slots/jackpot
https://free-casino.example.org/bonus
http://online-poker.example.org/deposit
https://sports-bets.example.net/odds/today
http://bet-now.example.org/free-bets
https://lottery-win.example.net/claim/prize
http://click-farm.example.org/win/prize
https://cheap-pills.example.org/buy-now/order
http://discount-pills.example.net/no-prescription
https://pharma-deals.example.org/viagra/cheap
http://replica-watches.example.net/buy-now
https://loan-offers.example.net/buy-now/cash
http://payday-loans.example.org/apply/fast-cash
https://crypto-double.example.net/invest/profit
http://adult-chat.example.org/xxx/live
https://adult-video.example.net/xxx/free
http://xxx-cams.example.org/live
https://hot-dating.example.net/adult/meet
http://spam-links.example.org/de/44
https://link-farm.example.net/seo/backlinks
http://spam-hub.example.org/en/12?ref=x
https://spam-farm.example.org/en/97
http://seo-backlinks.example.net/cheap
https://ads-click.example.org/track/redirect
http://ad-tracker.example.net/click?id=5
https://popup-ads.example.org/banner
http://track-ads.example.net/pixel
https://warez-download.example.org/crack/keygen
http://free-keygen.example.net/serial
https://torrent-crack.example.org/full-download
http://free-followers.example.net/get-likes
https://get-rich.example.org/easy-money
http://miracle-diet.example.net/lose-weight-fast
https://win-iphone.example.org/free-gift
http://free-gift-cards.example.net/claim
"""
ALLOWED = """
https://blog.example.org/en/853/
https://m.example.net/en/25#top
http://www.example.org/de/39547.html
https://news.example.org/en/474.html
https://library.example.org/books/history
https://docs.example.net/guide/install
https://example.net/en/12213?utm_source=feed
http://example.org/fr/825?page=2
https://university.example.org/research/paper
https://museum.example.net/de/exhibits
https://www.thorand.example.net/en/310.html
http://blog.reanth.example.org/de/7712/
https://m.whither.example.net/en/44?page=1&ref=x
http://ationest.example.org/es/9120#top
https://www.bleared.example.net/de/118
http://northern.example.org/en/61
https://weather.example.net/en/forecast
http://recipes.example.org/soup/tomato
https://gardening.example.net/roses/pruning
http://railway.example.org/timetable/north
https://theatre.example.net/tickets/season
http://school.example.org/calendar
https://hospital.example.net/visiting-hours
http://city-council.example.org/minutes/2019
https://parks.example.net/trails/map
http://astronomy.example.org/planets/mars
https://chess-club.example.net/lessons
http://history-society.example.org/archive/letters
https://open-source.example.net/project/readme
http://language-learning.example.org/grammar/verbs
https://bird-watching.example.net/species
http://cooking-school.example.org/bread
https://maps.example.net/en/202?utm_source=feed
http://encyclopedia.example.org/wiki/river
https://trusted-books.example.net/catalogue
http://adventure-travel.example.org/islands/winter
"""
# Words of which further labelled URLs are made, subjects and ends of paths of each kind.
BLOCKED_SUBJECTS = "casino poker slots jackpot betting lottery pills pharmacy viagra replica payday loans crypto-double adult xxx dating cams spam link-farm backlinks popup adtracker warez keygen torrent followers get-rich miracle-diet free-gift claim-prize".split()
BLOCKED_ENDS = "win bonus free-spins buy-now order cheap discount fast-cash prize click live/hot serial crack get-likes".split()
ALLOWED_SUBJECTS = "library museum university school hospital railway theatre gardening recipes weather history astronomy chess encyclopedia maps news blog docs research council parks birds cooking language archive forum travel music thorand whither reanth bleared northern ationest southern weaver".split()
ALLOWED_ENDS = "books guide paper calendar timetable trails planets lessons letters readme grammar species wiki catalogue en/417 de/8812/ fr/61.html es/2045 en/9 en/77310.html".split()
MADE = 120


def made_url(n: int, subjects: list[str], ends: list[str]) -> str:
    """The n-th labelled URL made of words: each subject meets another end each time round."""
    subject, end = subjects[n % len(subjects)], ends[(n * 5 + n // len(subjects)) % len(ends)]
    second = subjects[(n * 7 + 3) % len(subjects)]
    host = (f"{subject}.example.org", f"www.{subject}-{second}.example.net", f"{second}.{subject}.example.org", f"m.{subject}.example.net")[n % 4]
    return f"{('http', 'https')[n // 2 % 2]}://{host}/{end}{('', '?page=2', '#top', '?ref=x')[n // 3 % 4]}"


LABELLED = [(url, label) for urls, label in ((BLOCKED, 1), (ALLOWED, 0)) for url in urls.split()]
LABELLED += [(made_url(n, BLOCKED_SUBJECTS, BLOCKED_ENDS), 1) for n in range(MADE)] + [(made_url(n, ALLOWED_SUBJECTS, ALLOWED_ENDS), 0) for n in range(MADE)]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``, null if none."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = found.when(fits, value)
    return found


def grams(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram of host and path, each with its field's mark."""
    parts = []
    for mark, text in (("h", host), ("p", path)):
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        for n in GRAMS:
            parts.append(buckets(mark, padded, n))
    return F.concat(*parts)


def buckets(mark: str, text: Column, n: int) -> Column:
    """Bucket of every n-gram of a text (of the whole text, if it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def probability(weights: Column, own: Column) -> Column:
    """Logistic of the mean weight of the n-grams, the last weight being the bias."""
    total = F.aggregate(own, F.lit(0.0), lambda s, g: s + F.element_at(weights, g + 1))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double")) + F.element_at(weights, F.lit(BUCKETS + 1)))))


def train(labelled: DataFrame) -> list[float]:
    """Weights from ``labelled(url, label)``: gradient descent in DataFrame operations.

    A weight vector reached from zero by gradient steps is a sum of the rows' features,
    each times a coefficient, so the steps need only the rows' inner products: these are
    one join and sum over buckets, the steps one fold over the small matrix, and the
    weights one more sum. Rows with null url or label are left out; more than
    ``MOST_LABELLED`` rows are an error.
    """
    known = labelled.where("url is not null and label is not null")
    if (n := known.limit(MOST_LABELLED + 1).count()) > MOST_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    if not n:
        return [0.0] * (BUCKETS + 1)
    rows = known.select("url", F.col("label").cast("double").alias("y"), (F.row_number().over(Window.orderBy("url", "label")) - 1).alias("i"))
    own = rows.select("i", "y", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("g"))
    features = own.select("i", "y", F.size("g").alias("n"), F.explode("g").alias("bucket")).groupBy("i", "y", "n", "bucket").agg((F.count("*") / F.sqrt(F.first("n").cast("double"))).alias("x"))
    left, right = features.alias("l"), features.alias("r")
    products = left.join(right, F.col("l.bucket") == F.col("r.bucket")).groupBy(F.col("l.i").alias("i"), F.col("l.y").alias("y"), F.col("r.i").alias("j")).agg(F.sum(F.col("l.x") * F.col("r.x")).alias("k"))
    lines = products.groupBy("i", "y").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("ks"))
    matrix = lines.agg(F.sort_array(F.collect_list(F.struct("i", "y", "ks"))).alias("rows"))

    def step(state: Column, _: Column) -> Column:
        z = lambda r: F.aggregate(r["ks"], state["bias"], lambda s, p: s + p["k"] * F.element_at(state["a"], p["j"] + 1))
        off = F.transform("rows", lambda r: 1 / (1 + F.exp(-z(r))) - r["y"])
        a = F.zip_with(state["a"], off, lambda x, e: x * (1 - RATE * RIDGE) - e * (RATE / n))
        return F.struct(a.alias("a"), (state["bias"] - F.aggregate(off, F.lit(0.0), lambda s, e: s + e) * (RATE / n)).alias("bias"))

    start = F.struct(F.array_repeat(F.lit(0.0), n).alias("a"), F.lit(0.0).alias("bias"))
    fitted = matrix.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("s"))
    each = fitted.select(F.posexplode("s.a").alias("i", "a"))
    weights = features.join(each, "i").groupBy("bucket").agg(F.sum(F.col("a") * F.col("x")).alias("w"))
    out = [0.0] * BUCKETS + [fitted.select("s.bias").first()[0]]
    for row in weights.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["w"]
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` of every row of ``pages(page_id, url)``.

    The verdict is the longest fitting rule's, else block where the regression says more
    than one half (exactly one half: allow). Null, empty or malformed urls have empty host and path and are
    judged by the regression; urls of any length are judged whole; repeated rows and null ids are kept, an empty
    table stays empty, other columns are dropped. Rules of one length that fit the same url stand in the order given.
    """
    weights = F.array(*[F.lit(w) for w in train(labelled)])
    url = F.col("url").cast("string")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = cut.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("p_block", F.when(F.col("r").isNull(), probability(weights, grams(F.col("host"), F.col("path")))))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "p_block")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table."""
    rows = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def op10(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")
