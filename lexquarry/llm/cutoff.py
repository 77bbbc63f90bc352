"""Problem 3: values whose end is missing.

Intact values are cut artificially, with and without the marks that systems put in place of the
rest, to make positives; a logistic regression on hashed features of the end of a value (closing
characters, punctuation, shapes of the last words, open brackets and quotation marks, words since
the last end of a sentence, whether the length is a limit of its field) learns to tell the two
apart; all values are scored. What is intact is not known beforehand: a first model on the coarse features
alone, which cannot learn single values by heart, sorts out the stored values that look like the
artificial ones; the full model is fitted without them. Fitted on at most ``FIT_VALUES`` values a field; lengths are counted over all values.

Defined results. Null and blank values are not cut off. Repeated rows count once in ``cut_values``.
Empty tables give no rows. Values are read whole.
"""

from __future__ import annotations

import re
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.linear import Logistic, Rows, bounded_sample, hashed, sigmoid

FIT_VALUES = 8_000
#: A stored value that the coarse model gives more than this is not taken for intact.
DOUBT = 0.1
# What systems put in place of a missing rest, and escapes broken by a byte limit.
MARKS = [
    "", "", "", "", "", "", "", "", "…", " …", "...", " ...", "..", "[…]", " […]", "[...]", " [...]", " (more)", "(more)", "(cont.)", " [more]", " Read more",
    " [cut]", " [truncated]", " read more", " >>", " »", "-", " -", "–", "<b", "<br", " <b", "</", "<", "&amp", " &amp", "&nb", " &nb", "&#82", "&#", "&",
    "%E2%8", "%E2", "%", "%2", "\\u20", "\\u", "\\", "�",
]
_DIGIT = re.compile(r"\d+")
_LOWER = re.compile(r"[^\W\d_A-Z]+")
_UPPER = re.compile(r"[A-Z]+")
_END = re.compile(r"""[.?!।]["'”’)\]]*(?=\s|$)""")
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    return _LOWER.sub("a", _UPPER.sub("A", _DIGIT.sub("9", token)))


def names_of(text: str, limits: frozenset[int], coarse: bool = False) -> list[str]:
    """The feature names of a value; the coarse ones hold no words."""
    end = text.rstrip()
    masked = _DIGIT.sub(lambda m: "9" * min(len(m.group()), 4), end[-40:])
    tokens = _TOKEN.findall(end[-160:])[-6:]
    shapes = [shape(t) for t in tokens]
    pad = ["^"] * (6 - len(tokens))
    shapes, lower = pad + shapes, pad + [t.lower() for t in tokens]
    stops = [m.end() for m in _END.finditer(end)]
    since = len(end[stops[-1] :].split()) if stops else len(end.split()) + 50
    far = "0" if since == 0 else "few" if since <= 3 else "some" if since <= 8 else "many" if since < 50 else "all"
    opened = [
        f"({np.sign(end.count('(') - end.count(')'))}",
        f"[{np.sign(end.count('[') - end.count(']'))}",
        f"“{np.sign(end.count('“') - end.count('”'))}",
        f'"{end.count(chr(34)) % 2}',
    ]
    if coarse:
        last = shape(masked[-1:])
        return [f"c={last}", f"c2={shape(masked[-2:])}", f"s2={' '.join(shapes[-2:])}", f"s4={' '.join(shapes[-4:])}", f"far={far}{last}", f"open={''.join(opened)}{last}"]
    names = [f"c{n}={masked[-n:]}" for n in (1, 2, 3, 4, 5)]
    names += [
        f"s1={shapes[-1]}", f"s2={' '.join(shapes[-2:])}", f"s3={' '.join(shapes[-3:])}", f"s4={' '.join(shapes[-4:])}",
        f"w1={lower[-1]}", f"w2={lower[-2]} {shapes[-1]}", f"w3={lower[-3]} {lower[-2]} {shapes[-1]}",
        f"far={far}", f"far+c={far}{masked[-1:]}", f"far+s2={far} {shapes[-2]} {shapes[-1]}",
        f"limit={len(text) in limits}", f"blank={len(end) < len(text)}", *opened, f"open={''.join(opened)}{masked[-1:]}",
    ]
    return names


def limits_of(values: DataFrame) -> dict[str, frozenset[int]]:
    """Of each field, the lengths that stand out from their neighbours: limits of storage or transfer.

    One row a length and field reaches the driver, and lengths beyond ``2**20`` are counted as one.
    """
    counted = values.groupBy("field_name", F.least(F.length("value"), F.lit(1 << 20)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    wide = {}
    for row in counted.where("n >= 5").collect():
        wide.setdefault(row.field_name, {})[row["size"]] = row.n
    out = {}
    for field, n in wide.items():
        around = lambda k, n=n: np.median([n.get(k + d, 0) for d in range(-8, 9) if d])
        out[field] = frozenset(k for k, c in n.items() if c > 3 * (around(k) + 2))
    return out


def cut(value: str, rng: random.Random, limits: list[int]) -> str | None:
    """``value`` cut at random or at a limit of its field, inside a word or a sentence."""
    body = value.rstrip()
    if len(body) < 30:
        return None
    usable = [k for k in limits if 20 < k < len(body)]
    at = rng.choice(usable) if usable and rng.random() < 0.4 else rng.randrange(20, len(body) - 2)
    head = body[:at]
    if _END.search(head[-4:].rstrip() + " ") and head.rstrip()[-1:] in ".?!”\"])":
        return None  # ends with a sentence
    if re.search(r"\w$", head) and not re.match(r"\w", body[at:]) and _END.match(body[at:]):
        return None  # only the full stop is missing: too close to call
    return (head if rng.random() < 0.5 else head.rstrip()) + rng.choice(MARKS)


def train(values: DataFrame, fit_values: int = FIT_VALUES, seed: int = 11) -> tuple[Logistic, dict[str, frozenset[int]]]:
    """The model and the limits of the fields, from ``values`` (field_name, record_id, value)."""
    limits = limits_of(values)
    rng = random.Random(seed)
    fields = [r[0] for r in values.select("field_name").distinct().collect()]
    whole, parts = [], []
    for field in sorted(fields):
        own = values.where((F.col("field_name") == field) & (F.length(F.trim("value")) >= 30))
        texts = sorted({r[0] for r in bounded_sample(own, "record_id", fit_values).select("value").collect()})
        near = sorted(limits.get(field, ()))
        for text in texts:
            whole.append((field, text))
            made = cut(text, rng, near)
            if made:
                parts.append((field, made))
    model = Logistic()
    if not whole or not parts:
        return model, limits
    for coarse in (True, False):
        row = lambda pair: hashed(names_of(pair[1], limits.get(pair[0], frozenset()), coarse))  # noqa: B023, E731
        negative, positive = [row(p) for p in whole], [row(p) for p in parts]
        y = np.concatenate([np.zeros(len(negative)), np.ones(len(positive))])
        model = Logistic().fit(Rows(negative + positive), y, np.ones(len(y)), epochs=5)
        doubtful = sigmoid(Rows(negative).scores(model.w, model.b)) > DOUBT
        whole = [p for p, bad in zip(whole, doubtful) if not bad]
    return model, limits


def scored(values: DataFrame, fit_values: int = FIT_VALUES) -> DataFrame:
    """``values`` with ``score``, the model's probability that the value was cut off."""
    spark = values.sparkSession
    model, limits = train(values, fit_values)
    used = np.flatnonzero(model.w)
    shared = spark.sparkContext.broadcast((used, model.w[used], model.b, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, w, b, limits = shared.value
        held = Logistic()
        held.w[used] = w
        held.b = b
        for batch in batches:
            fields, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [hashed(names_of(t, limits.get(f, frozenset()))) for f, t in zip(fields, texts)]
            z = sigmoid(Rows(rows).scores(held.w, held.b)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z)], ["field_name", "record_id", "score"])

    usable = values.select("field_name", "record_id", "value").where("trim(value) <> ''")
    return usable.mapInArrow(run, "field_name string, record_id string, score double")


def values_of(raw: DataFrame, evidence: DataFrame) -> DataFrame:
    def one(df: DataFrame, key: str, field: str) -> DataFrame:
        return df.select(F.lit(field).alias("field_name"), F.col(key).alias("record_id"), F.col(field).alias("value"))

    parts = one(raw, "raw_id", "snippet").unionByName(one(evidence, "evidence_id", "statement"))
    return parts.unionByName(one(evidence, "evidence_id", "verbatim_quote")).where("value is not null and record_id is not null")


def cut_values(values: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(values).where(F.col("score") > threshold).select("field_name", "record_id").distinct()


def cut_rates(raw: DataFrame, evidence: DataFrame, research_source: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each field and source the records with a value, the cut ones and their share.

    The source is the provider of a snippet, and the source_type of the evidence's source. A record
    of an unknown source counts under null.
    """
    kinds = research_source.groupBy("source_id", "run_id").agg(F.min("source_type").alias("source"))
    of_raw = raw.groupBy(F.col("raw_id").alias("record_id")).agg(F.min("provider").alias("source"))
    of_raw = of_raw.withColumn("from_raw", F.lit(True))
    link = evidence.groupBy(F.col("evidence_id").alias("record_id")).agg(F.min(F.struct("source_id", "run_id")).alias("k"))
    of_evidence = link.select("record_id", "k.source_id", "k.run_id").join(kinds, ["source_id", "run_id"], "left")
    of_evidence = of_evidence.select("record_id", "source", F.lit(False).alias("from_raw"))
    marked = scored(values_of(raw, evidence)).groupBy("field_name", "record_id").agg(F.max("score").alias("score"))
    marked = marked.withColumn("from_raw", F.col("field_name") == "snippet")
    return (
        marked.join(of_raw.unionByName(of_evidence), ["record_id", "from_raw"], "left")
        .groupBy("field_name", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > threshold).alias("n_cut"))
        .withColumn("rate", F.col("n_cut") / F.col("n"))
    )
