"""URL filter: host rules first, else logistic regression on hashed character n-grams of host and path.

Everything on the main path is DataFrame functions: splitting, rule lookup, hashing n-grams, and scoring by a
sum over a fixed-size weight array. The model is trained on a small labelled URL table of bounded size: its
features come from the same functions, and the gradient steps over those few rows are taken on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm.common import ascii_lower

#: Size of the hashed feature space, and lengths of n-grams.
BUCKETS, NGRAMS = 8192, (3, 4, 5)
#: A labelled table may hold this many rows at most; it is a hand-made list, not data that grows.
MOST_LABELLED = 5000

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: A small labelled table: words that the hosts or paths of blocked urls have in common, by the kinds that public block
#: lists name (drugs, gambling, adult, loans, malware, piracy, counterfeits, advertising, spam), and words of other sites.
_BAD = (
    "viagra cialis pharmacy pills meds casino poker jackpot slots betting lottery porn xxx sex escort webcam nude adult dating payday loans credit-fix crypto-profit malware "
    "phishing trojan keygen crack warez torrent serial replica fake-watches counterfeit adserver popup clicks tracker banners spam spammer junk-mail link-farm free-gift prizes winner bonus cheap miracle-diet weight-loss"
).split()
_GOOD = (
    "news library docs wiki museum weather school forum garden university college hospital government city council science physics chemistry history geography music theatre cinema books journal magazine review "
    "travel hotel restaurant recipes kitchen bakery farm market shop store bank insurance law office post mail search maps photos gallery design studio software project code archive data research institute society "
    "church sports football tennis cycling running health clinic dentist pets nature birds forest river mountain ocean energy solar build paint tools garage cars trains flights tickets events calendar jobs career"
).split()
_NAMES = (
    "smith jones garcia muller rossi dubois ivanov tanaka nguyen kowalski hansen silva oxford cambridge london paris berlin madrid rome vienna prague lisbon dublin oslo tokyo sydney toronto chicago boston denver "
    "houston stanford princeton apache linux python ubuntu github reuters times herald tribune gazette guardian observer express daily world open bird stone bridge street field water flower orchard castle "
    "hill valley island harbor station corner house home family kids baby wedding party summer winter spring autumn red green blue silver golden north south east west first second three seven alpha beta delta"
).split()
_PLAIN = ("about", "contact", "articles/2021/05/spring-in-town", "en/index.html", "fr/12.html", "de/7731", "es/40", "products/481", "blog/how-to-begin", "wiki/Main_Page", "search", "img/logo.png", "a/b/c", "")
_TLDS, _SUBS = ("com", "org", "net", "info", "eu", "io", "gov", "edu", "co.uk", "biz"), ("", "www.", "m.", "blog.", "en.", "shop.", "my.", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in training table: url, label (1: block). A blocked url has its word in the host, joined with a common one, or in the path."""
    rows = []
    for i, w in enumerate(_BAD):
        for j in range(6):
            common, plain, sub, tld = _GOOD[(7 * i + 13 * j) % len(_GOOD)], _PLAIN[(i + 3 * j) % len(_PLAIN)], _SUBS[(i + j) % 8], _TLDS[(3 * i + j) % 10]
            host = (w, f"{w}-{common}", f"{common}{w}", f"{common}-{w}", f"{w}{common}", common)[j]
            rows.append((f"http{'s' * (j % 2)}://{sub}{host}.{tld}/{plain if j < 5 else w + '/' + plain}", 1))
    for i, w in enumerate(_GOOD):
        for j in range(4):
            other, plain, sub, tld = _GOOD[(11 * i + 5 * j + 1) % len(_GOOD)], _PLAIN[(2 * i + 5 * j) % len(_PLAIN)], _SUBS[(i + 3 * j) % 8], _TLDS[(i + 7 * j) % 10]
            host = (w, f"{w}-{other}", f"{other}{w}", w[0] + str(j))[j]
            rows.append((f"http{'s' * (i % 2)}://{sub}{host}.{tld}/{plain if j < 3 else w + '/' + plain}", 0))
    for i, w in enumerate(_NAMES):
        for j in range(4):
            other, plain, sub, tld = _NAMES[(17 * i + 29 * j + 3) % len(_NAMES)], _PLAIN[(3 * i + 5 * j) % len(_PLAIN)], _SUBS[(3 * i + j) % 8], _TLDS[(7 * i + 3 * j) % 10]
            host = (w, f"{w}{other}", f"{w}-{other}", f"{w}.example" if i % 4 == 0 else f"{other}-and-{w}")[j]
            rows.append((f"http{'s' * (j % 2)}://{sub}{host}.{tld}/{plain}", 0))
    return spark.sql("select * from values " + ", ".join(f"('{u}', {y})" for u, y in rows) + " as t(url, label)")


def host_of(url: Column) -> Column:
    """From after the first :// to the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end to the next ? or #; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. A rule fits its host, all subdomains, and paths that start with its own."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def buckets_of(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams, host's and path's apart by a mark; an empty array for an empty url."""
    marked = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(marked) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*map(grams, NGRAMS)))


def train(labelled: DataFrame, steps: int = 100, rate: float = 200.0, l2: float = 2e-5) -> tuple[float, list[float]]:
    """(bias, BUCKETS weights) by gradient descent on mean log loss. Null labels are left out; an empty table gives zeros.

    At most MOST_LABELLED rows are used. Repeated rows count each.
    """
    rows = labelled.where("label is not null").select("label", buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("b")).limit(MOST_LABELLED).collect()
    w, bias = [0.0] * BUCKETS, 0.0
    if not rows:
        return bias, w
    data = [(float(r.label), list(r.b), 1.0 / math.sqrt(len(r.b) or 1)) for r in rows]
    for _ in range(steps):
        g, gb = [0.0] * BUCKETS, 0.0
        for y, b, scale in data:
            z = bias + scale * sum([w[i] for i in b])
            d = (1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) - y) / len(data)
            gb += d
            d *= scale
            for i in b:
                g[i] += d
        bias -= gb
        w = [x - rate * (gx + l2 * x) for x, gx in zip(w, g, strict=True)]
    return bias, w


def judge(pages: DataFrame, model: tuple[float, list[float]], rules: Sequence[tuple[str, str, str]] = RULES, cutoff: float = 0.5, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score (probability of block) to pages, keeping other columns but for those names.

    Null urls and urls without :// have an empty host and path, no rule, and the model's verdict on the empty
    url. Rows without a key are judged like others. An empty table gives an empty result; equal urls get equal
    verdicts, and a very long one is judged whole. Of rules that fit equally long, the last given wins.
    """
    bias, w = model
    weights = F.split(F.lit(" ".join(f"{x:.9g}" if x else "0" for x in w)), " ").cast("array<double>")  # no lambda, so it is folded to a constant
    added = ("host", "path", "rule", "verdict", "score")
    d = pages.select(*[c for c in pages.columns if c not in added], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    b = buckets_of(F.col("host"), F.col("path"))
    total = F.aggregate(b, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    z = F.lit(bias) + total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))
    d = d.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("score", 1.0 / (1.0 + F.exp(-z)))
    return d.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("score") > cutoff, F.lit("block")).otherwise(F.lit("allow")))).drop("by_rule")
