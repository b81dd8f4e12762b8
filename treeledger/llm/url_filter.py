"""URL filters: host rules, and logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver from a small labelled URL table (a few hundred rows at
most) by full-batch gradient descent with a fixed start, so its weights are the same in every
run. Its weights, ``2 ** BITS`` numbers, travel with the scoring function.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path, fits no
rule and is left to the classifier, which allows it; repeated rows stay repeated; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BITS, SIZES = 13, (3, 4, 5)

#: (action, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words that make up the hosts and paths of the labelled table.
BAD_HOSTS = "cheap-pills adult-x casino-win spam-farm ads-track free-bets poker-bonus xxx-cams warez-crack payday-loan viagra-shop torrent-leak click-fraud lottery-prize fake-luxury porn-tube slot-jackpot phish-login malware-drop escort-dates".split()
GOOD_HOSTS = "news library museum weather university garden recipes history science health music travel railway hospital council journal archive school theatre forum".split()
BAD_PATHS = "/win/now /xxx/1 /buy-pills/cheap /bet/bonus /track/click /en/12 /fr/340 /de/77 /casino/slots /free/download".split()
GOOD_PATHS = "/en/120 /fr/45/ /de/9.html /es/301 /about /articles/2020/03 /blog/post /docs/index.html /en/640?page=2 /en/77".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block)."""
    rows = []
    for label, hosts, paths in ((1, BAD_HOSTS, BAD_PATHS), (0, GOOD_HOSTS, GOOD_PATHS)):
        for i, host in enumerate(hosts):
            for j, prefix in enumerate(("", "www.", "blog.", "m.")):
                rows.append((f"https://{prefix}{host}.example.{('com', 'net', 'org')[(i + j) % 3]}{paths[(i + 3 * j) % len(paths)]}", label))
    return rows


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(size, rule, action) of the longest rule that fits, else null. Of rules as long, the last in alphabetical order."""
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(h).alias("h"), F.lit(p).alias("p")) for a, h, p in rules])
    fits = F.filter(listed, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def buckets(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of a host and a path."""
    got = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            for i in range(len(text) - n + 1):
                got.add(zlib.crc32(f"{mark}{n}{text[i : i + n]}".encode()) & ((1 << BITS) - 1))
    return np.fromiter(got, dtype=np.int64, count=len(got))


def split_url(url: str | None) -> tuple[str, str]:
    """The same parts as ``url_parts``, of one url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def train(rows: Sequence[tuple[str, int]], rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier. With no rows, all is allowed."""
    weights, bias = np.zeros(1 << BITS), -1.0
    if not rows:
        return weights, bias
    x = np.zeros((len(rows), 1 << BITS))
    for i, (url, _) in enumerate(rows):
        got = buckets(*split_url(url))
        x[i, got] = 1 / np.sqrt(max(len(got), 1))
    y = np.array([label for _, label in rows], dtype=float)
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(x @ weights + bias))) - y
        weights -= rate * (x.T @ off / len(y) + decay * weights)
        bias -= rate * 0.01 * off.mean()
    return weights, float(bias)


def block_score(host: Column, path: Column, rows: Sequence[tuple[str, int]]) -> Column:
    weights, bias = train(rows)

    @F.pandas_udf(DoubleType())
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(h: str, p: str) -> float:
            got = buckets(h, p)
            return 1 / (1 + np.exp(-(weights[got].sum() / np.sqrt(max(len(got), 1)) + bias)))

        return pd.Series([one(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    return score(host, path)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rows: Sequence[tuple[str, int]] | None = None, at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of each page. A rule goes before the score."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = parts.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("block_score", block_score(F.col("host"), F.col("path"), labelled_urls() if rows is None else rows))
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("block_score") >= at, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
