"""URL filter: listed rules first, else a logistic regression on hashed
character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table (``SEEDS``,
a parameter). Scoring is one pass over the URLs inside a pandas UDF, without
any shuffle: all n-grams of a batch are hashed at once with array arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)

#: (host, path) that a person marked as unwanted, then as wanted.
BLOCKED = [(h + d, p) for h, d, p in [
    ("cheap-pills", ".example.com", "/fr/12"), ("www.cheap-pills", ".example.org", "/buy-now"),
    ("pharma-pills", ".example.net", "/order"), ("pills4you", ".example.com", "/en/1.html"),
    ("viagra-store", ".example.com", "/discount"), ("free-bets", ".example.com", "/de/3"),
    ("m.free-bets", ".example.net", "/odds"), ("casino-bets", ".example.org", "/slots"),
    ("online-casino", ".example.com", "/jackpot"), ("best-casino-bonus", ".example.net", "/es/9"),
    ("poker-bets", ".example.com", "/win"), ("adult-x", ".example.net", "/en/7"),
    ("www.adult-x", ".example.com", "/cams"), ("xxx-adult", ".example.org", "/video"),
    ("porn-x", ".example.com", "/free"), ("adult-cams", ".example.com", "/fr/2"),
    ("ads-track", ".example.org", "/en/584"), ("blog.ads-track", ".example.com", "/pixel"),
    ("track-ads", ".example.net", "/click"), ("adserver-track", ".example.com", "/banner"),
    ("popup-ads", ".example.com", "/es/55.html"), ("spam-farm", ".example.org", "/en/728"),
    ("link-farm-spam", ".example.com", "/seo"), ("content-farm", ".example.net", "/spam"),
    ("seo-spam", ".example.com", "/backlinks"), ("www.spam-farm", ".example.net", "/de/41/")]]
ALLOWED = [(h + d, p) for h, d, p in [
    ("www.library", ".example.com", "/en/12"), ("museum", ".example.org", "/fr/3.html"),
    ("blog.garden", ".example.net", "/es/200/"), ("news.city", ".example.com", "/de/41"),
    ("weather", ".example.net", "/en/today"), ("recipes", ".example.com", "/de/77"),
    ("docs.python", ".example.org", "/tutorial"), ("www.school", ".example.com", "/fr/825"),
    ("history", ".example.org", "/es/19"), ("m.travel", ".example.com", "/en/341"),
    ("sports.daily", ".example.net", "/fr/7/"), ("science", ".example.com", "/articles/2"),
    ("www.music", ".example.net", "/en/9.html"), ("forum.chess", ".example.org", "/thread/88"),
    ("books", ".example.com", "/de/503"), ("health.clinic", ".example.org", "/en/55"),
    ("thornton", ".example.net", "/es/533/"), ("blog.stonehen", ".example.com", "/en/340"),
    ("www.therwood", ".example.org", "/fr/588"), ("anderson", ".example.com", "/de/32.html"),
    ("northern", ".example.net", "/en/667"), ("m.hersted", ".example.com", "/es/245"),
    ("inghouse", ".example.org", "/en/572/"), ("thatcher", ".example.net", "/fr/723/"),
    ("blog.tionen", ".example.com", "/de/101/"), ("www.eastend", ".example.com", "/en/761")]]
SEEDS = [(h, p, 1) for h, p in BLOCKED] + [(h, p, 0) for h, p in ALLOWED]

#: (verdict, host and path prefix), as the contract lists them.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram_slots(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of every text. Texts are joined
    with a zero byte; n-grams over a border are left out."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.uint64)
    border = joined == 0
    owner = np.cumsum(border) - border
    who, slots = [], []
    for n in GRAMS:
        m = len(joined) - n + 1
        if m <= 0:
            continue
        code, cut = np.full(m, n, dtype=np.uint64), np.zeros(m, dtype=bool)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + joined[k:k + m]
            cut |= border[k:k + m]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0x9E3779B97F4A7C15)
        keep = ~cut
        who.append(owner[:m][keep])
        slots.append((code[keep] >> np.uint64(64 - 15)).astype(np.int64))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(slots)


def url_bytes(host: str, path: str) -> bytes:
    return ("^" + host + "$" + path).replace("\0", " ").encode("utf-8", "replace")


def means(texts: Sequence[bytes], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's n-grams over the root of their count."""
    who, slots = gram_slots(texts)
    total = np.bincount(who, weights=weights[slots], minlength=len(texts))
    count = np.bincount(who, minlength=len(texts))
    return total / np.sqrt(np.maximum(count, 1))


def fit(seeds=SEEDS, rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent on the mean log loss, with
    ridge decay. The order of the seeds does not matter."""
    texts = [url_bytes(h, p) for h, p, _ in seeds]
    y = np.array([label for *_, label in seeds], dtype=float)
    who, slots = gram_slots(texts)
    scale = 1 / np.sqrt(np.bincount(who, minlength=len(texts)))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(means(texts, w) + b)))
        err = (p - y) / len(y)
        w -= rate * (np.bincount(slots, weights=(err * scale)[who], minlength=BUCKETS) + decay * w)
        b -= rate * err.sum()
    return w, b


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. The
    rules become one CASE from the longest to the shortest."""
    rule, verdict = F, F
    for decision, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(decision))
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS,
          threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, score, verdict.

    A URL without a rule is blocked when the model's probability reaches
    ``threshold``. A null URL or one without ``://`` has empty host and path
    and gets the model's verdict on them. Repeated rows are judged alike."""
    weights, bias = fit(seeds)
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        if not len(host):
            return pd.Series([], dtype=float)
        z = means([url_bytes(h, p) for h, p in zip(host, path)], weights) + bias
        return pd.Series(1 / (1 + np.exp(-z)))

    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.withColumn("score", score("host", "path"))
            .select("page_id", "host", "path", rule.alias("rule"), "score",
                    F.coalesce(verdict, F.when(F.col("score") >= threshold, F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict")))
