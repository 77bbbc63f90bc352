"""Recorded fetch responses: classification, retries, text out of HTML and pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.urls import host_suffixes

MAX_BYTES = 40 * 1024 * 1024
_SKIPPED = {"script", "style", "nav", "header", "footer", "noscript", "template"}
_BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "td"}


def retryable(status: Column, error: Column) -> Column:
    """TLS failures no, timeouts yes, 429 and 5xx yes, other 4xx no, unknown yes."""
    return (
        F.when(error.rlike("(?i)certificate|tls|ssl"), False)
        .when(error.rlike("(?i)timeout|timed out"), True)
        .when((status == 429) | (status >= 500), True)
        .when(status.between(400, 499), False)
        .otherwise(F.when(status.between(200, 399), False).otherwise(True))
    )


def backoff(attempt: Column, retry_after: Column, base: float = 1.0, cap: float = 30.0, now: Column | None = None) -> Column:
    """Seconds to wait: the server's wish (seconds or, with ``now``, an HTTP date) from 0 to ``cap``, else ``base``
    doubled with each attempt."""
    wish = retry_after.try_cast("double")
    if now is not None:
        date = F.try_to_timestamp(F.regexp_extract(retry_after, r"(\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
        wish = F.coalesce(wish, (F.unix_seconds(date) - F.unix_seconds(now)).cast("double"))
    return F.when(wish.isNotNull(), F.least(F.greatest(wish, F.lit(0.0)), F.lit(cap))).otherwise(base * F.pow(F.lit(2.0), attempt))


def outcome(status: Column, size: Column, text_length: Column, mime: Column) -> Column:
    """ok, thin (under 400 characters), empty (under 50), too_large, unsupported or http_<status>."""
    return (
        F.when(status != 200, F.concat(F.lit("http_"), status.cast("string")))
        .when(size > MAX_BYTES, "too_large")
        .when(~mime.rlike("(?i)html|pdf|text|xml"), "unsupported")
        .when(F.coalesce(text_length, F.lit(0)) < 50, "empty")
        .when(text_length < 400, "thin")
        .otherwise("ok")
    )


def pdf_quality(pages: DataFrame) -> DataFrame:
    """doc_id, text, confidence and is_quotable from the pages (doc_id, page_no, text)."""
    share = F.avg(F.when(F.length(F.btrim(F.coalesce("text", F.lit("")))) >= 20, 1.0).otherwise(0.0))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t"))))
    grouped = pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"), share.alias("share"))
    confidence = F.when(F.col("share") < 0.5, 0.4).when(F.col("share") < 0.9, 0.75).otherwise(0.95)
    return grouped.select("doc_id", "text", confidence.alias("confidence"), (F.col("share") >= 0.5).alias("is_quotable"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.depth += 1
        elif tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED and self.depth:
            self.depth -= 1
        elif tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(html: str) -> str:
    """The text outside scripts, styles and page furniture, one line per block."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def extract_html(pages: DataFrame) -> DataFrame:
    """``url``, text of ``html``; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [None if h is None else html_text(h) for h in batch["html"].tolist()]
            yield batch[["url", "text"]]

    return pages.select("url", "html").mapInPandas(run, "url string, text string")


def pacing(requests: DataFrame, rate: Column) -> DataFrame:
    """Requests (host, ts) that came sooner after the last one of their host than ``rate`` a second allows."""
    before = F.lag("ts").over(Window.partitionBy("host").orderBy("ts"))
    gap = (F.unix_micros("ts") - F.unix_micros(before)) / 1e6
    return requests.withColumn("gap", gap).where(F.col("gap") < 1 / rate)


# Fixed values: (requests in flight, requests a second) by host suffix, and requests in flight by provider.
HOST_CAPS = [
    ("indiankanoon.org", 1, 1.0),
    ("nclt.gov.in", 1, 1.0),
    ("nclat.gov.in", 1, 1.0),
    ("indiacode.nic.in", 1, 1.0),
]
PROVIDER_CAPS = {"tavily": 8, "exa": 8, "perplexity": 4, "indiankanoon": 2, "indiacode": 2, "serpapi": 6, "semantic_scholar": 4}


def host_caps(hosts: DataFrame, in_flight: int = 2, per_second: float = 2.0) -> DataFrame:
    """``host`` with its caps: those of the first suffix that fits, else the defaults. An equi-join on suffixes."""
    table = hosts.sparkSession.createDataFrame([(n, *row) for n, row in enumerate(HOST_CAPS)], "rule_no int, suffix string, in_flight int, per_second double")
    each = hosts.select("host").distinct()
    met = each.select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix")).join(table, "suffix")
    best = met.groupBy("host").agg(F.min(F.struct("rule_no", "in_flight", "per_second")).alias("r"))
    joined = each.join(best, "host", "left")
    return joined.select("host", F.coalesce("r.in_flight", F.lit(in_flight)).alias("in_flight"), F.coalesce("r.per_second", F.lit(per_second)).alias("per_second"))


def provider_cap(provider: Column, default: int = 4) -> Column:
    out = F.lit(default)
    for name, most in PROVIDER_CAPS.items():
        out = F.when(provider == name, most).otherwise(out)
    return out


#: (name, pattern of the URL) of ways to fetch a page other than a plain request; the first that fits is taken.
STRATEGIES = [("indiankanoon", r"(?i)^https?://(?:www\.)?indiankanoon\.org/doc/\d+")]


def strategy_of(url: Column, strategies: list[tuple[str, str]] = STRATEGIES) -> Column:
    """The first strategy whose pattern fits the URL, else ``http``."""
    out = F.lit("http")
    for name, pattern in reversed(strategies):
        out = F.when(url.rlike(pattern), name).otherwise(out)
    return out


def fetched_text(strategy: Column, special: Column, plain: Column) -> Column:
    """The text of the special way where it gave one, else that of the plain request."""
    return F.coalesce(F.when(strategy != "http", F.nullif(special, F.lit(""))), plain)


def choose_text(main: Column, selected: Column, whole: Column, least: int = 400) -> Column:
    """The main text if it is long enough, else the one of the selector, else the longer of main and whole text."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.when(size(main) >= least, main).when(size(selected) >= least, selected).when(size(whole) > size(main), whole).otherwise(main)
