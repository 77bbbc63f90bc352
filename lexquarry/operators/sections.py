"""Outlines and sections: valid references, offered evidence, covered issues, citations and calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of sources that never establish what the law is.
PRESS = ["legal_news", "firm_commentary"]


def valid_outline(sections: DataFrame, n_issues: Column) -> DataFrame:
    """Sections (run_id, section_no, title, issue_refs, depends_on) with the references that hold.

    ``issue_refs`` keeps numbers from 1 to ``n_issues`` in order; issues that no section has go to the last one, in
    order. ``depends_on`` becomes ``depends_nos``: of each title the latest earlier section so called.
    """
    kept = sections.withColumn("_n", n_issues).withColumn("refs", F.filter("issue_refs", lambda i: i.between(1, F.col("_n"))))
    whole = kept.groupBy("run_id").agg(F.flatten(F.collect_list("refs")).alias("_all"), F.max("section_no").alias("_last"), F.max("_n").alias("_most"))
    joined = kept.join(whole, "run_id")
    every = F.when(F.col("_most") > 0, F.sequence(F.lit(1), F.col("_most"))).otherwise(F.array().cast("array<int>"))
    missing = F.array_except(every, F.col("_all"))
    refs = F.when(F.col("section_no") == F.col("_last"), F.array_union("refs", missing)).otherwise(F.col("refs"))
    wanted = sections.select("run_id", "section_no", F.posexplode("depends_on").alias("pos", "title"))
    earlier = sections.select("run_id", "title", F.col("section_no").alias("dep_no"))
    met = wanted.join(earlier, ["run_id", "title"]).where("dep_no < section_no").groupBy("run_id", "section_no", "pos").agg(F.max("dep_no").alias("dep_no"))
    ordered = met.groupBy("run_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("pos", "dep_no"))).alias("d"))
    out = joined.select("run_id", "section_no", "title", refs.alias("issue_refs")).join(ordered, ["run_id", "section_no"], "left")
    return out.withColumn("depends_nos", F.coalesce(F.transform("d", lambda x: x["dep_no"]), F.array().cast("array<int>"))).drop("d")


def offered_evidence(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, section_no, evidence_id) a section may cite: evidence of one of its issues, once, with the place of
    the first issue it came by and the least ord there, which is its order."""
    wanted = sections.select("run_id", "section_no", F.posexplode("issue_refs").alias("issue_pos", "issue_no"))
    has = evidence.select("run_id", "evidence_id", "ord", F.explode(F.array_distinct("supports_issues")).alias("s"))
    has = has.select("run_id", "evidence_id", "ord", F.col("s").try_cast("int").alias("issue_no")).groupBy("run_id", "issue_no", "evidence_id").agg(F.min("ord").alias("ord"))
    met = wanted.join(has, ["run_id", "issue_no"]).groupBy("run_id", "section_no", "evidence_id").agg(F.min(F.struct("issue_pos", "ord")).alias("o"))
    return met.select("run_id", "section_no", "evidence_id", "o.issue_pos", "o.ord")


def evidence_line(outlet: Column, url_host: Column, source_type: Column, published: Column) -> Column:
    """The line by which a draft is told of evidence; the columns of the evidence go by their names."""
    tier = F.when(F.coalesce(source_type.isin(PRESS), F.lit(False)), "PRESS").otherwise("AUTHORITY")
    name = F.coalesce(F.nullif(outlet, F.lit("")), F.nullif(url_host, F.lit("")), F.lit("(unknown outlet)"))
    date = F.coalesce(published.cast("string"), F.lit("(undated)"))
    quote = F.coalesce(F.nullif("verbatim_quote", F.lit("")), F.lit("(no quote)"))
    text = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat_ws(" | ", "evidence_id", text(F.col("kind")), text(F.col("binding_strength")), tier, name, date, text(F.col("statement")), quote)


def covered_issues(sections: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(section_id, issue_no) of the issues of a section that evidence validly cited in it supports.

    ``sections`` has section_id and issue_refs, ``cited`` section_id and evidence_id.
    """
    supports = evidence.select("evidence_id", F.explode("supports_issues").alias("s")).where(F.col("s").rlike(r"^\d+$"))
    supports = supports.select("evidence_id", F.col("s").try_cast("int").alias("issue_no")).distinct()
    own = sections.select("section_id", F.explode("issue_refs").alias("issue_no")).distinct()
    credited = cited.select("section_id", "evidence_id").distinct().join(supports, "evidence_id").select("section_id", "issue_no").distinct()
    return own.join(credited, ["section_id", "issue_no"], "left_semi")


def unresolved_ratio(marks: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """Of each ``key`` all markers, those of known evidence without a citation, and their share of all (``marks``: key,
    evidence_id and ``ok``; ``citations``: evidence_id and citation)."""
    cited = citations.groupBy("evidence_id").agg(F.max("citation").alias("citation"))
    joined = marks.join(cited, "evidence_id", "left")
    bare = F.col("ok") & (F.coalesce("citation", F.lit("")) == "")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("markers"), F.count_if(bare).alias("bare")).withColumn("ratio", F.col("bare") / F.col("markers"))


def calc_issues(marks: DataFrame, calcs: DataFrame, inputs: DataFrame, offered: DataFrame) -> DataFrame:
    """What is wrong with a calculation cited in a section: section_id, calc_id, issue; those in order have no row.

    missing: the section has no such calculation; input: one of its inputs (section_id, calc_id, evidence_id) was not
    offered; shape: it cannot be computed (``computed`` is null); mismatch: the claim is another.
    """
    keys = ["section_id", "calc_id"]
    strange = inputs.join(offered.select("section_id", "evidence_id").distinct(), ["section_id", "evidence_id"], "left_anti").select(*keys).distinct()
    cited = marks.select(*keys).distinct()
    held = calcs.select(*keys, "computed", "claimed_result", F.lit(True).alias("_held")).dropDuplicates(keys)
    joined = cited.join(held, keys, "left").join(strange.withColumn("_strange", F.lit(True)), keys, "left")
    off = F.abs(F.col("computed") - F.col("claimed_result")) > F.greatest(F.abs("computed") * 0.01, F.lit(0.05))
    issue = F.when(F.col("_held").isNull(), "missing").when(F.col("_strange"), "input").when(F.col("computed").isNull(), "shape").when(F.coalesce(off, F.lit(True)), "mismatch")
    return joined.select(*keys, issue.alias("issue")).where("issue is not null")
