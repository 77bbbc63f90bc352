"""Problem 5: free-typed values mapped to the entries of a reference list.

Values are made distinct, normalised (letter case, camel case, punctuation, abbreviations, remarks
of the pipeline such as "(llm)"), and looked up in an inverted index of character n-grams over the
surface forms of the entries: the entry itself, its known other wordings and, for courts, its
initials. Grams weigh by their rarity among the forms. A value takes the entry with the highest
cosine if it is above ``threshold`` and leads the next entry by ``margin``; otherwise it is
reported with the empty string.

Defined results. Null values are left out; empty and blank values and an empty reference list give
the empty string. Values are compared whole. Repeated entries count once. Ties between two entries
lack the margin and give the empty string. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import settle

THRESHOLD, MARGIN = 0.44, 0.02
#: More surface forms than this are looked up in several passes.
MAX_FORMS = 100_000

# Other wordings of the entries that share few letters with them.
WORDINGS = {
    "holding": ["ratio", "ratio decidendi", "ruling", "decision", "binding holding", "held"],
    "obiter": ["obiter dictum", "obiter dicta", "dicta", "dictum", "passing remark", "obiter remark", "remark"],
    "statutory_text": ["statute", "statute text", "text of statute", "statutory provision", "provision", "stat text", "statutory wording"],
    "test_or_standard": ["test", "standard", "legal test", "legal standard", "test standard"],
    "definition": ["def", "defn", "definition clause", "definitions", "statutory definition", "meaning"],
    "procedural_fact": ["procedure fact", "procedural history", "proc fact", "procedure", "procedural facts", "fact procedural"],
    "statistic": ["stat", "stats", "statistics", "statistical data", "statistical figure", "statistik", "figure", "number"],
    "policy_rationale": ["rationale", "policy reason", "policy reasoning", "policy", "reason of policy"],
    "commentary_opinion": ["commentary", "opinion", "author opinion", "author view", "commentator opinion", "commentator view"],
    "missing_statutory_basis": ["no statutory basis", "lacks statutory basis", "missing statute", "no statute"],
    "missing_primary_authority": ["no primary authority", "lacks primary authorities", "no primary source", "missing primary source"],
    "missing_apex_ruling": ["no apex ruling", "no apex court decision", "apex court ruling missing", "no ruling of apex court", "missing apex court ruling", "no supreme court ruling"],
    "missing_counter_view": ["no counter view", "missing opposing view", "no counter argument", "missing counterview", "one sided", "one sided no counter view"],
    "stale_law": ["outdated law", "out of date law", "stale", "stale authority law", "old law", "obsolete law", "law is stale"],
    "jurisdiction_mismatch": ["wrong jurisdiction", "jurisdictional mismatch", "mismatched jurisdiction", "juris mismatch", "foreign jurisdiction"],
    "thin_coverage": ["insufficient coverage", "shallow coverage", "coverage too thin", "thin cov", "too little evidence", "weak coverage", "sparse coverage"],
    "unresolved_conflict": ["conflict", "unsettled conflict", "unresolved conflicting authorities", "conflicting authorities", "open conflict"],
    "no_implementation_detail": ["missing implementation detail", "lacks implementation details", "no impl detail", "implementation detail missing", "no practical detail"],
    "blocking": ["blocker", "block", "critical", "show stopper", "showstopper", "critical blocking"],
    "important": ["imp", "impt", "very important", "importance important"],
    "nice_to_have": ["nth", "nice 2 have", "optional", "would be nice to have", "optional nice to have", "nice to haves"],
}
# Abbreviations in the names of courts.
SHORT = {
    "hc": "high court", "sc": "supreme court", "ct": "court", "crt": "court", "cout": "court", "trib": "tribunal", "natl": "national", "nat": "national",
    "app": "appellate", "appl": "appellate", "cap": "capital", "mkts": "markets", "mkt": "markets", "comm": "commercial", "comml": "commercial",
    "com": "commercial", "fam": "family", "dist": "district", "distt": "district", "dc": "district court", "lc": "labour court", "fc": "family court",
    "cc": "commercial court", "labor": "labour", "apex": "supreme", "arb": "arbitration", "fed": "federal", "chmbr": "chamber", "insolv": "insolvency",
}
# Words that tell no court from another.
IDLE = {"the", "of", "at", "in", "for", "and", "a", "hon", "ble", "honble", "judicature", "principal", "bench", "judge"}
_NOISE = re.compile(r"\((?:llm|sic)\)|^\s*(?:kind|gap_kind|gap kind|gap|severity|court)\s*[:=]", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DOTTED = re.compile(r"\b(?:[A-Za-z]\.\s?){2,}")


def normalise(value: str, field: str) -> str:
    text = unicodedata.normalize("NFKC", value)
    text = _NOISE.sub(" ", text)
    text = _DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text)
    if not text.isupper():
        text = _CAMEL.sub(" ", text)
    text = re.sub(r"['’]s\b", "", text)
    words = re.findall(r"[^\W_]+", text.lower())
    if field == "court":
        words = [w for word in words for w in SHORT.get(word, word).split()]
        kept = [w for w in words if w not in IDLE]
        if "court" in words or "tribunal" in words:
            words = kept or words
        words = sorted(words, key=lambda w: (w in ("court", "tribunal"), w))
    else:
        words = [w for w in words if w not in ("the", "a", "an", "is")] or words
    return " ".join(words)


def grams(text: str) -> Counter[str]:
    """Runs of one to three characters of each word, its start and end marked, pairs around one
    character, and the letters in order, which swapped letters leave as they are."""
    out: Counter[str] = Counter()
    for word in text.split():
        marked = f"^{word}$"
        out.update(word)
        out["#" + "".join(sorted(word))] += 1
        out.update(marked[i : i + 2] for i in range(len(marked) - 1))
        out.update(marked[i : i + 3] for i in range(len(marked) - 2))
        out.update(f"{marked[i]}·{marked[i + 2]}" for i in range(len(marked) - 2))
    return out


def forms_of(field: str, entry: str) -> list[str]:
    forms = [normalise(entry, field), *(normalise(w, field) for w in WORDINGS.get(entry, ()))]
    if field == "court":
        names = [w for w in re.findall(r"[^\W_]+", entry.lower()) if w not in ("of", "the")]
        if len(names) >= 3:
            forms.append("".join(w[0] for w in names))
    return [f for f in dict.fromkeys(forms) if f]


class GramIndex:
    """Inverted index of weighted grams over the surface forms of a reference list."""

    def __init__(self, entries: list[tuple[str, str]], shared: dict[str, Counter[str]]):
        self.fields: dict[str, tuple[list[str], dict[str, list[tuple[int, float]]], dict[str, float], float, dict[str, list[str]]]] = {}
        for field in {f for f, _ in entries}:
            owners, bags, exact = [], [], {}
            for entry in sorted({e for f, e in entries if f == field}):
                for form in forms_of(field, entry):
                    owners.append(entry)
                    bags.append(grams(form))
                    same = exact.setdefault(form.replace(" ", ""), [])
                    same += [entry] if entry not in same else []
            df = shared[field]
            n = max(sum(1 for f, _ in entries if f == field), 1)
            weight = {g: math.log(1 + (n + 1) / (1 + k)) * (0.5 if len(g) == 1 else 1.0) for g, k in df.items()}
            unseen = 0.45 * math.log(2 + n)
            postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
            for i, bag in enumerate(bags):
                norm = math.sqrt(sum((k * weight.get(g, unseen)) ** 2 for g, k in bag.items()))
                for g, k in bag.items():
                    postings[g].append((i, k * weight.get(g, unseen) / norm))
            self.fields[field] = (owners, dict(postings), weight, unseen, exact)

    def best(self, field: str, value: str) -> list[tuple[float, str]]:
        """The two best entries for a value, with their scores."""
        if field not in self.fields:
            return []
        owners, postings, weight, unseen, exact = self.fields[field]
        form = normalise(value, field)
        if not form:
            return []
        if form.replace(" ", "") in exact:
            return [(1.0, entry) for entry in exact[form.replace(" ", "")][:2]]
        bag = grams(form)
        norm = math.sqrt(sum((k * weight.get(g, unseen)) ** 2 for g, k in bag.items()))
        dots: dict[int, float] = defaultdict(float)
        for g, k in bag.items():
            for i, w in postings.get(g, ()):
                dots[i] += k * weight.get(g, unseen) * w
        top: dict[str, float] = {}
        for i, dot in dots.items():
            top[owners[i]] = max(top.get(owners[i], 0.0), dot / norm)
        return sorted(((round(s, 6), e) for e, s in top.items()), key=lambda x: (-x[0], x[1]))[:2]


def map_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, max_forms: int = MAX_FORMS) -> DataFrame:
    """field_name, typed_value and canon_value of each distinct value that is not itself an entry.

    ``values`` has field_name and typed_value, ``reference`` field_name and canon_value. The
    reference is the small side: it is read in blocks of at most ``max_forms`` forms, one pass over the
    distinct values for each, and the best two entries of every block are compared afterwards.
    """
    spark = values.sparkSession
    known = reference.select("field_name", F.col("canon_value").alias("typed_value")).where("typed_value is not null").distinct()
    fresh = values.where("typed_value is not null").select("field_name", "typed_value").distinct()
    fresh = fresh.join(known, ["field_name", "typed_value"], "left_anti")
    df: dict[str, Counter[str]] = defaultdict(Counter)
    for row in known.toLocalIterator():  # grams are few, however long the list
        df[row.field_name].update({g for form in forms_of(row.field_name, row.typed_value) for g in grams(form)})

    def blocks() -> Iterator[tuple[list[tuple[str, str]], bool]]:
        now: list[tuple[str, str]] = []
        room = max_forms
        for row in known.orderBy("field_name", "typed_value").toLocalIterator():
            size = len(forms_of(row.field_name, row.typed_value))
            if now and size > room:
                yield now, True
                now, room = [], max_forms
            now.append((row.field_name, row.typed_value))
            room -= size
        yield now, False

    parts, several = None, False
    for block, more in blocks():
        shared = spark.sparkContext.broadcast((block, dict(df)))

        def look_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = GramIndex(*shared.value)
            for batch in batches:
                tops = [index.best(f, v) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                tops = [t + [(0.0, "")] * (2 - len(t)) for t in tops]
                columns = [pa.array([t[i][j] for t in tops], pa.float64() if j == 0 else pa.string()) for i in (0, 1) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["field_name", "typed_value", "s1", "e1", "s2", "e2"])

        part = fresh.mapInArrow(look_up, "field_name string, typed_value string, s1 double, e1 string, s2 double, e2 string")
        if more:  # a pass is done, and its block gone, before the next one is read
            part, several = settle(part, "looked_up"), True
            shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if several:  # at most two entries of each block come together
        best = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(F.array(F.struct("s1", "e1"), F.struct(F.col("s2").alias("s1"), F.col("e2").alias("e1"))))))), 1, 2)
        parts = parts.groupBy("field_name", "typed_value").agg(best.alias("b")).select(
            "field_name", "typed_value", F.col("b")[0]["s1"].alias("s1"), F.col("b")[0]["e1"].alias("e1"), F.col("b")[1]["s1"].alias("s2")
        )
    taken = (F.col("s1") >= threshold) & (F.col("s1") - F.col("s2") >= margin)
    return parts.select("field_name", "typed_value", F.when(taken, F.col("e1")).otherwise("").alias("canon_value"))


def typed_values(candidates: DataFrame, gaps: DataFrame, citations: DataFrame) -> DataFrame:
    def one(df: DataFrame, field: str) -> DataFrame:
        return df.select(F.lit(field).alias("field_name"), F.col(field).alias("typed_value"))

    return one(candidates, "kind").unionByName(one(gaps, "gap_kind")).unionByName(one(gaps, "severity")).unionByName(one(citations, "court"))


def mapping_report(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Of each field: distinct typed values, those mapped and those without an entry."""
    mapped = map_values(values, reference)
    return mapped.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("canon_value") != "").alias("n_mapped"), F.count_if(F.col("canon_value") == "").alias("n_unmatched")
    )
