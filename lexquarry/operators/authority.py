"""Source authority from an ordered table of host rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.urls import host_of, host_suffixes

# Fixed values: (host, tier, court level, issuing body, source type), the first that fits wins.
RULES = [
    ("sci.gov.in", 1, "supreme_court", "Supreme Court of India", "judgment"),
    ("digiscr.sci.gov.in", 1, "supreme_court", "Supreme Court of India", "judgment"),
    ("indiacode.nic.in", 1, "none", None, "statute"),
    ("egazette.gov.in", 1, "none", None, "gazette_notification"),
    ("judgments.ecourts.gov.in", 2, "high_court", None, "judgment"),
    ("hcservices.ecourts.gov.in", 2, "high_court", None, "judgment"),
    ("sebi.gov.in", 2, "none", "SEBI", "regulator_circular"),
    ("rbi.org.in", 2, "none", "RBI", "regulator_circular"),
    ("mca.gov.in", 2, "none", "MCA", "regulator_circular"),
    ("cci.gov.in", 2, "none", "CCI", "regulator_circular"),
    ("irdai.gov.in", 2, "none", "IRDAI", "regulator_circular"),
    ("trai.gov.in", 2, "none", "TRAI", "regulator_circular"),
    ("incometaxindia.gov.in", 2, "none", "CBDT", "regulator_circular"),
    ("cbic.gov.in", 2, "none", "CBIC", "regulator_circular"),
    ("ibbi.gov.in", 2, "none", "IBBI", "regulator_circular"),
    ("nclat.nic.in", 3, "tribunal_appellate", "NCLAT", "tribunal_order"),
    ("nclt.gov.in", 3, "tribunal", "NCLT", "tribunal_order"),
    ("greentribunal.gov.in", 3, "tribunal", "NGT", "tribunal_order"),
    ("lawcommissionofindia.nic.in", 3, "none", "Law Commission of India", "law_commission_report"),
    ("prsindia.org", 4, "none", "PRS Legislative Research", "committee_report"),
    ("ssrn.com", 4, "none", None, "academic"),
    ("papers.ssrn.com", 4, "none", None, "academic"),
    ("academic.oup.com", 4, "none", None, "academic"),
    ("link.springer.com", 4, "none", None, "academic"),
    ("jstor.org", 4, "none", None, "academic"),
    ("semanticscholar.org", 4, "none", None, "academic"),
    ("indiankanoon.org", 5, "none", None, "hint"),
    ("barandbench.com", 5, "none", None, "legal_news"),
    ("livelaw.in", 5, "none", None, "legal_news"),
    ("scconline.com", 5, "none", None, "firm_commentary"),
    ("indiacorplaw.in", 5, "none", None, "firm_commentary"),
    ("vinodkothari.com", 5, "none", None, "firm_commentary"),
    ("mondaq.com", 5, "none", None, "firm_commentary"),
    ("nishithdesai.com", 5, "none", None, "firm_commentary"),
    ("cyrilshroff.com", 5, "none", None, "firm_commentary"),
    ("khaitanco.com", 5, "none", None, "firm_commentary"),
    ("trilegal.com", 5, "none", None, "firm_commentary"),
    ("azbpartners.com", 5, "none", None, "firm_commentary"),
]
# Weight by tier.
WEIGHTS = {1: 1.00, 2: 0.85, 3: 0.65, 4: 0.50, 5: 0.30, 6: 0.0}


def rules(spark: SparkSession) -> DataFrame:
    rows = [(n, host, tier, court, body, kind) for n, (host, tier, court, body, kind) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_no int, domain string, tier int, court_level string, issuing_body string, source_type string")


def authority_weight(tier: Column) -> Column:
    out = F.lit(0.0)
    for t, w in WEIGHTS.items():
        out = F.when(tier == t, F.lit(w)).otherwise(out)
    return out


def cap_foreign_tier(tier: Column, jurisdiction: Column, run_jurisdiction: Column) -> Column:
    home = run_jurisdiction.isin("IN", "IN_STATE")
    return F.when(home & ~jurisdiction.isin("IN", "IN_STATE"), F.greatest(tier, F.lit(4))).otherwise(tier)


def resolve_authority(df: DataFrame, url: str, hint: str) -> DataFrame:
    """``df`` with tier, court_level, issuing_body and resolved_type of its URL.

    The suffix rules are an equi-join on the suffixes of the distinct hosts; the first rule wins.
    """
    host = host_of(F.col(url))
    df = df.withColumn("_host", host)
    hosts = df.select("_host").distinct().withColumn("domain", F.explode(host_suffixes(F.col("_host"))))
    table = rules(df.sparkSession)
    first = F.min_by(F.struct("tier", "court_level", "issuing_body", "source_type"), "rule_no")
    ruled = hosts.join(table, "domain").groupBy("_host").agg(first.alias("rule"), F.min("rule_no").alias("rule_no"))
    kanoon = F.col("_host").isNotNull() & (F.col("rule.source_type") == "hint")
    judgment = kanoon & F.col(url).rlike(r"/doc/\d+")
    court = F.col("_host").rlike(r"highcourt|hc\.in|hcourt\.gov\.in$")
    state = F.col("_host").rlike(r"\.(gov|nic)\.in$")
    study = F.col("_host").rlike("journal|nlsiu|nujs|nluj|nlu")
    hinted = F.coalesce(F.col(hint), F.lit("other"))

    def choose(rule: Column, high: object, gov: object, academic: object, rest: object) -> Column:
        return F.when(F.col("rule").isNotNull(), rule).when(court, high).when(state, gov).when(study, academic).otherwise(rest)

    return df.join(ruled, "_host", "left").select(
        *[c for c in df.columns if c != "_host"],
        choose(F.when(judgment, 2).otherwise(F.col("rule.tier")), F.lit(2), F.lit(3), F.lit(4), F.lit(6)).alias("tier"),
        choose(F.when(judgment, "high_court").otherwise(F.col("rule.court_level")), F.lit("high_court"), F.lit("none"), F.lit("none"), F.lit("none")).alias("court_level_resolved"),
        F.col("rule.issuing_body").alias("issuing_body_resolved"),
        choose(F.when(judgment, "judgment").when(kanoon, hinted).otherwise(F.col("rule.source_type")), F.lit("judgment"), hinted, F.lit("academic"), hinted).alias("resolved_type"),
    )
