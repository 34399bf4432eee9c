"""URL filters: lists of hosts and paths, and boosted trees on lexical features for all other URLs.

Features are counted, and trees applied, by Spark expressions."""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwork.llm.boosting import Boosted, boosted
from formwork.llm.common import beside, written


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Parts of a URL whose statistics are features: endings of the host and of the path, and the first step of the path.
PARTS = ("last_label", "domain", "extension", "step")
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "parameters", "query_length", "entropy", "host_entropy")
FEATURES = (*(f"x_{c}" for c in LEXICAL), *(f"x_{p}_{s}" for p in PARTS for s in ("urls", "blocked")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path: from there up to ``?``, ``#`` or the end.  Empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(text, c, F.lit("")))).cast("double")))
    sums = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - sums / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features of one URL by itself, as doubles."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda text: F.when(F.length(text) > 0, count(text, "[0-9]") / F.length(text)).otherwise(0.0)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    length = lambda text: F.length(text).cast("double")
    values = [length(url), length(host), length(path), count(path, "/[^/]"), count(host, r"[^.]+"), share(url), share(host), count(url, "[-_]"), count(query, "[^&;]+"), length(query), _entropy(url), _entropy(host)]
    return {f"x_{c}": v for c, v in zip(LEXICAL, values)}


def parts(host: Column, path: Column) -> dict[str, Column]:
    """The ``PARTS`` of a URL; empty where it has none."""
    values = [F.regexp_extract(host, r"[^.]*$", 0), F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), F.regexp_extract(path, r"^/([^/]*)", 1)]
    return {f"p_{p}": v for p, v in zip(PARTS, values)}


@dataclass(frozen=True)
class UrlModel:
    """Trees, and statistics of parts: ``part, value, urls, n0, n1, blocked0, blocked1`` (labelled and
    blocked URLs by fold); ``share``: of blocked URLs in all labelled ones."""

    trees: Boosted = field(default_factory=Boosted)
    statistics: DataFrame | None = None
    share: float = 0.5

    def featured(self, rows: DataFrame, labelled: bool) -> DataFrame:
        """``rows`` (columns of ``_prepared``) with statistics of their parts as features.

        Rows that were ``labelled`` get what the other fold's labels say."""
        for p in PARTS:
            mine = self.statistics.filter(F.col("part") == p).drop("part").withColumnRenamed("value", f"p_{p}")
            rows = beside(rows, mine, f"p_{p}", how="left")
            n, bad = (F.coalesce(F.when(F.col("fold") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0")) if labelled else F.col(f"{c}0") + F.col(f"{c}1"), F.lit(0)) for c in ("n", "blocked"))
            rows = rows.withColumn(f"x_{p}_urls", F.log2(1.0 + F.coalesce("urls", F.lit(0)))).withColumn(f"x_{p}_blocked", (bad + F.lit(5.0 * self.share)) / (n + 5.0)).drop("urls", "n0", "n1", "blocked0", "blocked1")
        return rows


def _prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``url``, ``host``, ``path``) with lexical features, parts and the URL's fold."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return rows.select("*", *(v.alias(k) for k, v in {**lexical(url, F.col("host"), F.col("path")), **parts(F.col("host"), F.col("path"))}.items()), F.pmod(F.xxhash64("url"), F.lit(2)).alias("fold"))


def fit(urls: DataFrame, per_verdict: int = 20_000, trees: int = 60, depth: int = 3) -> UrlModel:
    """Fit on ``urls``: ``url, host, path, blocked`` (null where a URL has no label).

    Statistics of parts count all rows.  Trees are fitted on the driver, on up to ``per_verdict`` labelled URLs (distinct, least hash
    first) of each verdict; the share of verdicts in all labelled rows sets the base.  A labelled
    URL's statistics come from the labels of the other half of URLs.  A URL with both
    labels counts as blocked in the sample.  Without URLs of both verdicts there are no trees, and the model allows all.
    """
    counted = urls.select("blocked", F.pmod(F.xxhash64("url"), F.lit(2)).alias("fold"), F.explode(F.map_from_arrays(F.array(*map(F.lit, PARTS)), F.array(*parts(F.col("host"), F.col("path")).values()))).alias("part", "value"))
    of = lambda fold, c: F.count_if((F.col("fold") == fold) & c)
    known, bad = F.col("blocked").isNotNull(), F.coalesce(F.col("blocked"), F.lit(False))
    table = written(counted.groupBy("part", "value").agg(F.count("*").alias("urls"), of(0, known).alias("n0"), of(1, known).alias("n1"), of(0, bad).alias("blocked0"), of(1, bad).alias("blocked1")))
    n, n_bad = table.filter(F.col("part") == PARTS[0]).agg(F.sum(F.col("n0") + F.col("n1")), F.sum(F.col("blocked0") + F.col("blocked1"))).first()
    if not n or not 0 < n_bad < n:
        return UrlModel()
    model = UrlModel(statistics=table, share=n_bad / n)
    once = urls.filter(known).groupBy("url").agg(F.max("blocked").alias("blocked"), F.first("host").alias("host"), F.first("path").alias("path"))
    each = [once.filter(F.col("blocked") == b).orderBy(F.xxhash64("url"), "url").limit(per_verdict) for b in (False, True)]
    sample = model.featured(_prepared(reduce(DataFrame.unionByName, each)), labelled=True).select("url", "blocked", *FEATURES).toArrow().sort_by("url")
    x = np.column_stack([sample.column(c).to_numpy() for c in FEATURES])
    y = sample.column("blocked").to_numpy(zero_copy_only=False).astype(float)
    base = float(np.log(n_bad / (n - n_bad)))
    return UrlModel(boosted(x, y, FEATURES, base, trees, depth), table, n_bad / n)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url", per_verdict: int = 20_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each row.

    The longest rule that fits decides (of equal lengths the first); URLs that a rule fits are the labels of the
    model, which decides the rest: block where ``score``, the log odds of it, is above 0.

    A null URL, or one without ``://``, has empty host and path and is judged by its other features.  Equal and null
    ids are rows of their own; URLs of any length count as a whole; other columns are ignored; an
    empty table gives no rows.  Where no rule fits or all say the same, the score is null and the
    model allows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url")).select("*", host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: -len(r.text))
    first = lambda value: F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))) for r in by_length), F.lit(None).cast("string"))
    rows = rows.withColumn("rule", first(lambda r: r.text)).withColumn("ruled", first(lambda r: r.verdict))
    model = fit(rows.select("url", "host", "path", (F.col("ruled") == "block").alias("blocked")), per_verdict)
    if model.statistics is None:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        rows = model.featured(_prepared(rows), labelled=False).withColumn("score", model.trees.column())
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
