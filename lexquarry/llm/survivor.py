"""Problem 6: the best representative of each group of duplicate records.

``page_groups`` finds the groups, ``best_rows`` takes each field from the row a stated
preference ranks first, ``truth_discovery`` estimates how reliable each provider is and gives
each field its best supported value.

Defined results. Null or blank URL or null run: the row belongs to no group. Empty table: no
rows. Rows that agree in every column: one group, ties go to the smaller ``ord``. Columns that
the operators do not name are ignored, so extra columns cannot clash. Very long values are
compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.session import settle

# Tracking parameters.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "ref", "source", "mc_cid", "mc_eid",
]


def page_key(url: Column) -> Column:
    """A URL without what does not change the page; null for a null or blank URL.

    Dropped: scheme, letter case of the host, one leading ``www.``, the port, slashes at the end
    of the path, the fragment, tracking parameters and the order of the parameters.
    """
    bare = F.regexp_replace(F.trim(url), r"(?i)^\s*(?:https?:)?//", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(head, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(head, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING),
        )
    )
    return F.when(F.trim(url) != "", F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


def page_groups(raw: DataFrame) -> DataFrame:
    """The columns of a delivery that matter here, with ``page``; rows without a page are left out."""
    return raw.select(
        "run_id", page_key(F.col("url_canonical")).alias("page"), "ord", "url_canonical", "title", "published_at", "provider", "fetched_at",
    ).where(F.col("page").isNotNull() & F.col("run_id").isNotNull())


def best_rows(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per group of two or more deliveries of one page in one run.

    The group is never brought together: each field's winner is an aggregate of constant size, so
    a page that holds a third of all rows is reduced before the shuffle.
    """
    trust = trust.where("provider is not null").groupBy("provider").agg(F.max("trust").alias("trust"))
    late = F.coalesce(F.unix_micros("fetched_at"), F.lit(-(2**62)))
    title_length = F.length(F.trim("title"))
    dated = F.col("published_at") <= F.to_date("fetched_at")
    first = F.col("ord")

    def winner(usable: Column, *order: Column) -> Column:
        """The ord of the usable row that comes last in ``order``, then smallest in ord."""
        best = F.max(F.when(usable, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], (-first).alias("last"))))
        return F.coalesce(-best["last"], F.lit(-1).cast("long"))

    return (
        rows.join(trust, "provider", "left")
        .groupBy("run_id", "page")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ord").alias("first_ord"),
            winner(title_length > 0, title_length, late).alias("title_ord"),
            winner(dated, F.col("published_at")).alias("published_ord"),
            winner(F.col("trust").isNotNull(), F.col("trust"), late).alias("provider_ord"),
        )
        .where("n >= 2")
    )


def truth_discovery(
    claims: DataFrame, max_rounds: int = 8, tolerance: float = 1e-3, prior: float = 0.7, strength: float = 4.0, choices: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Alternate between source reliability and weighted votes until neither changes.

    ``claims`` has ``object``, ``field``, ``value`` and ``source``. Repeated claims of one source
    for one value count once. A source that claims k values for one field of one object splits
    its vote into k parts, so repetition earns nothing. The support of a value is the sum of its
    sources' weights ``ln(choices * r / (1 - r))``, a wrong claim being taken for one of ``choices``; the
    reliability r of a source is the support share of its claims, drawn towards ``prior`` with ``strength`` pseudo-claims. Gives the winning value of
    each object and field (ties: the smaller value) and the reliabilities.

    A null value, source or object claims nothing. The number of sources may grow: they are a
    table of their own, joined by the planner's choice, and only the largest change of a round
    reaches the driver.
    """
    claims = claims.where("object is not null and field is not null and value is not null and source is not null")
    claims = claims.select("object", "field", "value", "source").distinct()
    split = claims.groupBy("object", "field", "source").agg(F.count(F.lit(1)).alias("k"))
    claims = settle(claims.join(split, ["object", "field", "source"]).withColumn("part", 1.0 / F.col("k")).drop("k"), "claims")
    rates = claims.groupBy("source").agg(F.sum("part").alias("n")).withColumn("r", F.lit(prior))
    support = None
    for _ in range(max_rounds):
        weighted = claims.join(rates.select("source", "r"), "source").withColumn(
            "vote", F.col("part") * F.log(choices * F.col("r") / (1 - F.col("r")))
        )
        support = weighted.groupBy("object", "field", "value").agg(F.sum("vote").alias("support"))
        total = support.groupBy("object", "field").agg(F.sum(F.exp("support")).alias("total"))
        support = support.join(total, ["object", "field"]).withColumn("share", F.exp("support") / F.col("total")).drop("total")
        news = (
            claims.join(support, ["object", "field", "value"])
            .groupBy("source")
            .agg(F.sum("part").alias("n"), F.sum(F.col("part") * F.col("share")).alias("right"))
            .select(
                "source", "n",
                F.least(F.lit(0.99), F.greatest(F.lit(0.05), (F.col("right") + prior * strength) / (F.col("n") + strength))).alias("r"),
            )
        )
        news = settle(news, "reliability")
        change = (
            news.join(rates.select("source", F.col("r").alias("was")), "source").agg(F.max(F.abs(F.col("r") - F.col("was")))).first()[0]
        )
        rates = news
        if change is None or change < tolerance:
            break
    else:
        raise RuntimeError(f"truth discovery did not settle in {max_rounds} rounds")
    best = support.groupBy("object", "field").agg(
        F.max_by("value", F.struct(F.round("support", 9).alias("s"), F.col("share"))).alias("_"),
        F.max(F.round("support", 9)).alias("support"),
    )
    tied = support.select("object", "field", "value", F.round("support", 9).alias("support"))
    winners = tied.join(best.drop("_"), ["object", "field", "support"]).groupBy("object", "field", "support").agg(F.min("value").alias("value"))
    return winners, rates


def p6_found(raw: DataFrame, trust: DataFrame) -> DataFrame:
    return best_rows(page_groups(raw), trust).select("first_ord", "title_ord", "published_ord", "provider_ord")


def p6_truth(raw: DataFrame) -> DataFrame:
    """Each group's best supported title, date and spelling of its URL by truth discovery; first_ord names the group.

    The provider is the source whose reliability is estimated; it claims nothing about itself, so it has no votes.
    """
    rows = settle(page_groups(raw), "pages")
    groups = rows.groupBy("run_id", "page").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    claim = rows.join(groups, ["run_id", "page"])
    title = claim.select(F.col("first_ord").alias("object"), F.lit("title").alias("field"), F.nullif(F.trim("title"), F.lit("")).alias("value"), F.col("provider").alias("source"))
    dated = claim.where(F.col("published_at") <= F.to_date("fetched_at"))
    date = dated.select(F.col("first_ord").alias("object"), F.lit("published_at").alias("field"), F.col("published_at").cast("string").alias("value"), F.col("provider").alias("source"))
    url = claim.select(F.col("first_ord").alias("object"), F.lit("url_canonical").alias("field"), F.trim("url_canonical").alias("value"), F.col("provider").alias("source"))
    winners, _ = truth_discovery(title.unionByName(date).unionByName(url))
    return winners.select(F.col("object").alias("first_ord"), "field", "value")
