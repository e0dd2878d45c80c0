"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the beginning of a path; it fits its host and all subdomains, and the longest
that fits decides. What no rule decides is judged by boosted trees on the URL's length, depth, digit
ratio, character entropy, parameter counts, telling words and how often labelled URLs of the same host suffixes
were blocked. They are trained from labelled URLs, at most ``SAMPLE`` of them, the smallest by hash; a row's
suffix statistics come from the half of these that it is not in. The verdicts of rules are no labels, as trees
would only learn the rules from them: without URLs of the caller's, a fixed, seeded set of generated ones is
taken, of ordinary sites and of the habits of advertising, gambling, adult and spam sites. The trees become column
expressions, so rows never leave the JVM; only the sample's numbers come to the driver.
"""

from __future__ import annotations

import math
import string
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soilspark.llm.sampling import sampled

ALLOW, BLOCK = "allow", "block"
SAMPLE = 4_000
TREES, DEPTH, RATE, CUTS, RIDGE = 30, 3, 0.3, 16, 1.0
RULES_AS_LITERALS = 64
MAX_BROADCAST_RULES = 200_000

FEATURES = "n_url n_host n_path depth digits entropy n_params n_query has_fragment n_dots n_hyphens n_digits_path secure extension n_telling odds1 seen1 odds2 seen2".split()
# fixed values: words that URLs of unwanted sites are made of
TELLING = set(
    "ads adserver adult affiliate banner bet bets betting bingo bonus cams cash casino cheap click clicks crypto dating deals discount escort farm free gamble hot jackpot loan loans lotto lucky meds money "
    "offer offers pharma pharmacy pill pills poker popup porn prize promo replica sale sex slot slots spam tracker track tracking viagra vip warez win winner xxx".split()
)


@dataclass(frozen=True)
class Rule:
    """``text`` is host then path, like ``example.com/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        _, slash, rest = self.text.partition("/")
        return slash + rest


RULES = [Rule("com/", ALLOW), Rule("example.com/en/", BLOCK), Rule("www.example.com/en/", ALLOW), Rule("net/es/", BLOCK), Rule("net/fr/", BLOCK)]


# --- host, path and rules --------------------------------------------------------------------------------------------------------------


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (host, path and others) with rule and rule_verdict, null where none fits.

    A few rules are literals in one projection; many are joined by host suffix with the distinct (host, path), broadcast up to a checked number.
    Of rules of equal length the one that sorts last wins.
    """
    if len(rules) <= RULES_AS_LITERALS:
        fits = [
            F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
            for r in rules
        ]
        none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
        best = F.array_max(F.array(none, *fits))
        return urls.withColumn("__r", best).withColumn("rule", F.col("__r.rule")).withColumn("rule_verdict", F.col("__r.verdict")).drop("__r")
    table = urls.sparkSession.createDataFrame([(r.host, r.path, len(r.text), r.text, r.verdict) for r in rules], "rhost string, rpath string, n int, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("rhost", F.explode(suffixes))
    best = each.join(F.broadcast(table) if len(rules) <= MAX_BROADCAST_RULES else table, "rhost").where(F.col("path").startswith(F.col("rpath")))
    best = best.groupBy("host", "path").agg(F.max(F.struct("n", "rule", "verdict")).alias("r")).select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))
    return urls.join(best, ["host", "path"], "left")


# --- features --------------------------------------------------------------------------------------------------------------------------


def described(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and others) with the lexical features and the host suffixes suffix1 and suffix2."""
    u = F.coalesce("url", F.lit(""))
    n = F.char_length(u)
    number = lambda col, what: (F.char_length(col) - F.char_length(F.replace(col, F.lit(what)))).cast("double")
    digits = lambda col: F.char_length(F.regexp_replace(col, "[^0-9]", "")).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.char_length(u) - F.char_length(F.replace(u, c))) / F.char_length(u)
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return urls.withColumns({
        "n_url": n.cast("double"), "n_host": F.char_length("host").cast("double"), "n_path": F.char_length("path").cast("double"), "depth": number(F.col("path"), "/"),
        "digits": F.when(n > 0, digits(u) / n).otherwise(0.0), "entropy": F.when(n > 0, entropy).otherwise(0.0), "n_params": F.when(query == "", 0.0).otherwise(number(query, "&") + 1),
        "n_query": F.char_length(query).cast("double"), "has_fragment": F.contains(u, F.lit("#")).cast("double"), "n_dots": number(F.col("host"), "."), "n_hyphens": number(u, "-"),
        "n_telling": F.size(F.array_intersect(F.split(F.translate(F.concat("host", F.lit("/"), "path"), string.ascii_uppercase, string.ascii_lowercase), "[^a-z]+"), F.array(*map(F.lit, sorted(TELLING))))).cast("double"),
        "n_digits_path": digits(F.col("path")), "secure": u.startswith("https:").cast("double"), "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix1": F.element_at(labels, -1), "suffix2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
    })


# --- trees -----------------------------------------------------------------------------------------------------------------------------


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple]]:
    """(start, trees) of logistic loss. A tree is (feature, cut, left, right), rows of at most the cut go left, or a number."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    start = math.log(share / (1 - share))
    score = np.full(len(y), start)
    trees = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
        if level == DEPTH or len(rows) < 8:
            return leaf
        least = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
        best, where = least + 1e-6, None
        for f in range(x.shape[1]):
            if len(cuts[f]) < 2:
                continue
            left = x[rows, f][:, None] <= cuts[f][None, :]
            gl, hl = g[rows] @ left, h[rows] @ left
            gain = gl**2 / (hl + RIDGE) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + RIDGE)
            k = int(np.argmax(gain))
            if gain[k] > best and left[:, k].any() and not left[:, k].all():
                best, where = float(gain[k]), (f, float(cuts[f][k]))
        if where is None:
            return leaf
        left = x[rows, where[0]] <= where[1]
        return (*where, grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1))

    def value(tree, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] = tree
            return
        left = x[rows, tree[0]] <= tree[1]
        value(tree[2], rows[left], out)
        value(tree[3], rows[~left], out)

    if len(np.unique(y)) == 2:
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = grow(np.arange(len(y)), y - p, p * (1 - p), 0)
            step = np.zeros(len(y))
            value(tree, np.arange(len(y)), step)
            score += step
            trees.append(tree)
    return start, trees


def _expression(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], _expression(tree[2])).otherwise(_expression(tree[3]))


@dataclass(frozen=True)
class Model:
    """Boosted trees and the log-odds and numbers of blocked URLs by suffix (at most ``SAMPLE`` of each kind)."""

    start: float
    trees: list
    suffixes: tuple[dict[str, tuple[float, float]], dict[str, tuple[float, float]]]


def _statistics(names: list[str], y: np.ndarray) -> dict[str, tuple[float, float]]:
    out: dict[str, list[int]] = {}
    for s, b in zip(names, y, strict=True):
        n = out.setdefault(s, [0, 0])
        n[int(b)] += 1
    return {s: (math.log((b + 1) / (a + 1)), math.log1p(a + b)) for s, (a, b) in out.items()}


def labelled_urls(seed: int = 3, n: int = SAMPLE) -> list[tuple[str, int]]:
    """(url, blocked 0/1): ``n`` URLs, half of them as unwanted sites make them."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    syllables = "an ber co dan el fer gra hol in ka lo mar ne or pa ri sol ta ul ver wen yo".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(2, 5))))
    digits = lambda a, z: "".join(str(int(rng.integers(10))) for _ in range(int(rng.integers(a, z))))
    jumble = lambda k: "".join(pick(string.ascii_lowercase + string.digits) for _ in range(k))
    telling, ends = sorted(TELLING), "com net org info biz de fr es io co.uk example.com example.net example.org".split()

    def ordinary() -> str:
        host = pick(["", "www.", "m.", "blog.", "news.", "en."]) + (word() if rng.random() < 0.8 else f"{word()}-{word()}") + "." + pick(ends)
        path = pick([f"/{pick(['en', 'de', 'fr', 'es'])}/{digits(1, 6)}", "/" + "-".join(word() for _ in range(int(rng.integers(2, 7)))), f"/{word()}/{word()}", f"/20{digits(2, 3)}/{digits(2, 3)}/{word()}-{word()}", "/", f"/{word()}?id={digits(1, 5)}", f"/{pick(['shop', 'news', 'free', 'track', 'sale'])}/{word()}"])
        return pick(["http", "https"]) + "://" + host + path + pick(["", "", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top"])

    def unwanted() -> str:
        name = pick([f"{pick(telling)}-{pick(telling)}", f"{pick(telling)}-{pick(telling)}", f"{pick(telling)}{digits(1, 4)}", f"{word()}-{pick(telling)}", f"{pick(telling)}-{jumble(1)}", jumble(14), f"{pick(telling)}.{word()}"])
        host = pick(["", "www.", "m.", f"{pick(telling)}.", "blog."]) + (name + "." + pick(ends) if rng.random() < 0.93 else ".".join(str(int(rng.integers(256))) for _ in range(4)))
        params = "&".join(f"{jumble(3)}={jumble(int(rng.integers(4, 20)))}" for _ in range(int(rng.integers(3, 9))))
        path = pick([f"/{pick(['en', 'de', 'fr', 'es'])}/{digits(1, 6)}", f"/{pick(telling)}/{jumble(12)}", f"/{jumble(8)}/{jumble(8)}/{jumble(8)}", "/", f"/{word()}", f"/c?{params}", f"/{pick(telling)}-{pick(telling)}-{digits(2, 6)}"])
        return pick(["http", "http", "https"]) + "://" + host + path + pick(["", "", "/", ".html", "#top", "" if "?" in path else "?page=2&ref=x", "" if "?" in path else f"?{params}"])

    return [(unwanted(), 1) if k % 2 else (ordinary(), 0) for k in range(n)]


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from URLs (url, blocked 0/1), at most ``sample`` of them. Without any of one kind the model knows only the other."""
    some = sampled(labelled.where("url is not null and blocked is not null"), ["url", "blocked"], sample)
    own = described(some.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))))
    plain = FEATURES[:-4]
    rows = own.select("blocked", "url", "suffix1", "suffix2", *plain).collect()
    y = np.array([float(r["blocked"]) for r in rows])
    half = np.array([zlib.crc32(r["url"].encode()) & 1 for r in rows])
    x = np.zeros((len(rows), len(FEATURES)))
    if rows:
        x[:, : len(plain)] = [[r[f] for f in plain] for r in rows]
    stats = []
    for k, s in enumerate(("suffix1", "suffix2")):
        names = [r[s] for r in rows]
        stats.append(_statistics(names, y))
        for h in (0, 1):
            other = _statistics([n for n, o in zip(names, half, strict=True) if o != h], y[half != h])
            for i in np.flatnonzero(half == h):
                x[i, len(plain) + 2 * k : len(plain) + 2 * k + 2] = other.get(names[i], (0.0, 0.0))
    start, trees = boosted(x, y)
    return Model(start, trees, tuple(stats))


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (url, host, path and others) with p_block."""
    spark: SparkSession = urls.sparkSession
    out = described(urls)
    for k, stats in enumerate(model.suffixes, 1):
        table = spark.createDataFrame([(s, a, b) for s, (a, b) in stats.items()], f"suffix{k} string, odds{k} double, seen{k} double")
        out = out.join(F.broadcast(table), f"suffix{k}", "left").fillna({f"odds{k}": 0.0, f"seen{k}": 0.0})
    score = F.lit(model.start)
    for tree in model.trees:
        score = score + _expression(tree)
    return out.withColumn("p_block", 1 / (1 + F.exp(-score))).drop("suffix1", "suffix2", *FEATURES)


def judged(pages: DataFrame, rules: list[Rule] | None = None, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for each row of ``pages`` (page_id, url).

    Null URLs and those without ``://`` have an empty host and path and no rule. Repeated rows stay; a null page_id is passed on; an empty
    table gives no rows; other columns are left out. Without a model one is trained from ``labelled_urls``.
    """
    rules = RULES if rules is None else rules
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    urls = ruled(urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), rules)
    if model is None:
        model = train(pages.sparkSession.createDataFrame(labelled_urls(), "url string, blocked int"))
    out = scored(urls, model)
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "p_block")
