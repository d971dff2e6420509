"""URL filter: explicit rules first, then gradient-boosted trees on lexical features.

The trees learn from URLs with a label; where a table has none of its own, the URLs that a rule decides
are the labelled ones. Suffix statistics, of the last label of a host and of the last two, are counted over
all labelled URLs, not only over the sample that trees are fitted on. In training a URL has those of the
other folds of hosts, so that the trees trust a suffix only as far as it holds for hosts not yet seen.
Features, training labels and scores are Column expressions; the bounded training sample reaches the
driver, and of the statistics as many rows as ``MAP_ROWS`` says, beyond which they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import trees
from tideline.llm.common import lower_ascii, table
from tideline.plans.shared import Scratch

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: At most about so many labelled URLs are fitted on; folds of hosts; the weight of the overall share in that of
#: a suffix, in labelled URLs; suffixes whose statistics become part of the expression.
SAMPLE_ROWS, FOLDS, PRIOR, MAP_ROWS = 20_000, 5, 5.0, 2000
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_host_length", "f_suffix", "f_suffix_2", "f_seen")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, start = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. Of equal lengths the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        fits = _fits(text, host, path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _entropy(c: Column) -> Column:
    """Bits a character."""
    n = F.length(c)
    count = lambda ch: n - F.length(F.replace(c, ch, F.lit("")))
    bits = F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda a, ch: a + F.when(ch == "", 0.0).otherwise(count(ch) / n * F.log2(n / count(ch))))
    return F.when(n > 0, bits).otherwise(0.0)


def features(url: Column, host: Column, path: Column, shares: tuple[Column, Column, Column]) -> list[Column]:
    """Length, depth, digit ratio, entropy, parameter count, host labels and length, and suffix statistics:
    the shares of blocked URLs by the last label and by the last two, and how many of the latter were seen."""
    whole = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(whole), F.lit(1))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    parts = (
        F.length(whole),
        F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        F.regexp_count(whole, F.lit("[0-9]")) / n,
        _entropy(whole),
        F.when(query == "", 0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1),
        F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))),
        F.length(host),
        *shares,
    )
    return [c.cast("double").alias(f) for c, f in zip(parts, FEATURES, strict=True)]


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


class UrlModel:
    """Trees and, by host suffix (of one label and of two), how many labelled URLs there were and how many of
    them were blocked."""

    def __init__(self, boosted: trees.Boosted, counts: DataFrame | None, overall: float):
        self.boosted, self.overall = boosted, overall
        self.counts, self.held = counts, None
        if counts is not None:
            rows = counts.limit(MAP_ROWS + 1).collect()
            if len(rows) <= MAP_ROWS:
                self.held = {r.s: (r.n, r.b) for r in rows}

    def add_shares(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a host) with _s1, _s2 and _seen."""
        names = [("_s1", 1), ("_s2", 2)]
        if self.held is not None or self.counts is None:
            known = self.held or {}
            n = F.create_map(*(F.lit(x) for s, (c, _) in sorted(known.items()) for x in (s, float(c)))) if known else None
            blocked = F.create_map(*(F.lit(x) for s, (_, b) in sorted(known.items()) for x in (s, float(b)))) if known else None
            get = lambda m, k: F.lit(0.0) if m is None else F.coalesce(m[F.concat(F.lit(f"{k}/"), _suffix(F.col("host"), k))], F.lit(0.0))
            return rows.select("*", *(self._share(get(n, k), get(blocked, k)).alias(c) for c, k in names), F.log1p(get(n, 2)).alias("_seen"))
        for c, k in names:
            counts = self.counts.select(F.col("s").alias("_key"), F.col("n").alias(f"{c}n"), F.col("b").alias(f"{c}b"))
            rows = rows.withColumn("_key", F.concat(F.lit(f"{k}/"), _suffix(F.col("host"), k))).join(counts, "_key", "left").drop("_key")
            rows = rows.withColumn(c, self._share(F.coalesce(f"{c}n", F.lit(0)), F.coalesce(f"{c}b", F.lit(0.0)))).drop(f"{c}b")
        return rows.withColumn("_seen", F.log1p(F.coalesce("_s2n", F.lit(0)))).drop("_s1n", "_s2n")

    def _share(self, n: Column, blocked: Column) -> Column:
        return (blocked + PRIOR * self.overall) / (n + PRIOR)


def train(labelled: DataFrame, *, url_col: str = "url", block_col: str = "block", sample_rows: int = SAMPLE_ROWS, rounds: int = 24) -> UrlModel:
    """From URLs and whether they're blocked; rows with a null in either are not used. A bounded sample
    by hash of the URL is fitted on, so equal tables give equal models."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(block_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(block_col).cast("double").alias("b"))
    rows = rows.select("*", host_of(F.col("u")).alias("host"))
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS))
    keys = F.explode(F.array(*(F.concat(F.lit(f"{k}/"), _suffix(F.col("host"), k)) for k in (1, 2))))
    scratch = Scratch(labelled.sparkSession, "urls")
    # a row for each suffix and fold
    parts = scratch.keep(rows.select(keys.alias("s"), fold.alias("fold"), "b").groupBy("s", "fold").agg(F.count("*").alias("n"), F.sum("b").alias("b")), "counts")
    total = parts.where("startswith(s, '1/')").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n, overall = total.n or 0, ((total.b or 0.0) + 0.5) / ((total.n or 0) + 1)
    place = F.pmod(F.xxhash64("u"), F.lit(1 << 30))
    sample = rows.where(place < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30)) + 1)
    sample = sample.groupBy("u", "host").agg(F.avg("b").alias("b"))
    zero = F.lit(0.0)
    got = sample.select("b", fold.alias("fold"), *(F.concat(F.lit(f"{k}/"), _suffix(F.col("host"), k)).alias(f"k{k}") for k in (1, 2)), *features(F.col("u"), F.col("host"), path_of(F.col("u")), (zero, zero, zero))).collect()
    got.sort(key=tuple)
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    y = np.array([r.b >= 0.5 for r in got], float)
    wanted = {r[k] for r in got for k in ("k1", "k2")}  # suffixes of the bounded sample
    seen: dict[str, dict[int, tuple[int, float]]] = {}
    if wanted:
        here = labelled.sparkSession.createDataFrame([(s,) for s in sorted(wanted)], "s string")
        for r in parts.join(here, "s").collect():
            seen.setdefault(r.s, {})[r.fold] = (r.n, r.b)
    for row, r in zip(x, got, strict=True):
        for at, k in ((-3, "k1"), (-2, "k2")):
            others = [v for f, v in seen.get(r[k], {}).items() if f != r.fold]
            row[at] = (sum(b for _, b in others) + PRIOR * overall) / (sum(c for c, _ in others) + PRIOR)
            row[-1] = np.log1p(sum(c for c, _ in others))
    counts = parts.groupBy("s").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return UrlModel(trees.boost(x, y, rounds), counts, overall)


def judge(pages: DataFrame, model: UrlModel | None = None, *, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score added (or replaced).

    A null URL, or one without ``://``, has an empty host and path, so no rule fits and the model judges
    what there is of it. Verdicts without a rule are ``block`` from ``threshold`` up. Without a model the
    URLs that rules decide are the labelled ones; where there are none, everything else is allowed.
    Repeated rows are judged alike; an empty table gives no rows; other columns pass through.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    url = F.col(f"_row.`{url_col}`")
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row")).select("_row", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    base = base.select("*", rule.alias("rule"), verdict.alias("_rule_verdict"))
    if model is None:
        model = train(base.where("rule IS NOT NULL").select(url.alias("url"), (F.col("_rule_verdict") == "block").alias("block")))
    base = model.add_shares(base)
    scored = base.select("*", *features(url, F.col("host"), F.col("path"), (F.col("_s1"), F.col("_s2"), F.col("_seen")))).withColumn("block_score", F.expr(model.boosted.sql(list(FEATURES))))
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(*(F.col(f"_row.`{c}`").alias(c) for c in own), "host", "path", "rule", F.coalesce(F.col("_rule_verdict"), by_model).alias("verdict"), "block_score")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
