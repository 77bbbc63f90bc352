"""Problem 9: abusive, hateful or sexually explicit text.

A document is scored by its worst sentence. Words are normalised first (look-alike letters, hidden
characters, digits and signs for letters, spaced, stretched and masked spellings). The classifier is
a logistic regression on hashed words, pairs, triples and word outlines, fitted on the labelled
documents: only the document is labelled, so the sentences that carry a positive label are chosen
and the model refitted in turn. It is counterfactually regularised: in labelled sentences the
terms for groups, names of persons and places are swapped for others of their kind, and a change of
score is penalised, so that a group or a name is not taken for abuse.

Defined results. Null, empty and blank texts score 0 and are not to be reviewed. Without labels of
both kinds nothing is to be reviewed. Repeated labels count each; contradicting ones weigh less.
Texts are scored whole. Extra columns are ignored. At most ``FIT_LABELS`` labelled documents are used for
fitting; everything is scored.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.linear import Logistic, Rows, bounded_sample, sigmoid

FIT_LABELS = 8_000
LONGEST_SENTENCE = 64
BITS = 20

# General terms for groups of people. Names of groups that the texts themselves use join them.
GROUPS = [
    "women", "men", "girls", "boys", "muslims", "hindus", "christians", "jews", "sikhs", "buddhists", "atheists", "dalits", "brahmins", "migrants", "immigrants", "refugees",
    "foreigners", "strangers", "settlers", "tribals", "gay men", "lesbians", "transgender people", "disabled people", "old people", "young people", "poor people", "black people",
    "white people", "asians", "africans", "europeans", "northerners", "southerners", "villagers", "farmers", "workers", "students", "lawyers", "judges",
]
# Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans(
    "аеорсухікмтнвѕјԁɡһзьАЕОРСУХІКМТНВЅЈαοενικρτυχβ",
    "aeopcyxikmthbsjdgh3bAEOPCYXIKMTHBSJaoevikptuxb",
)
SIGNS = str.maketrans("$@0134578!|", "saoieastbii")
_HIDDEN = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_END = re.compile(r"[.!?।…]+[\"'”’)\]]*$")
_NUMBER = re.compile(r"[\d.,₹$€£%/()\[\]:;#§-]*\d[\d.,₹$€£%/()\[\]:;#§-]*[\"'”’]?$")
_APART = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
_SPELT = re.compile(r"(?:[^\W\d_][-.*_·~+|/\\,]){2,}[^\W\d_]")
_MASK = re.compile(r"[^\W\d_][\w]*[*#%&^]+[\w*#%&^]*")
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u0900-\u0dff])+(?:['’][^\W_]+)?")
_LONG = re.compile(r"([^\W\d_])\1{2,}")


def normal_words(chunk: str) -> tuple[tuple[str, ...], bool]:
    """The normalised words of a stretch without white space, and whether a sentence ends with it."""
    ends = bool(_END.search(chunk))
    if _NUMBER.match(chunk):
        return ("<n>",), ends
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", chunk))
    if not text.isascii() and re.search(r"[A-Za-z]", text):
        text = text.translate(LOOKALIKE)
    core = text.strip("\"'“”‘’()[]{}<>,.;:?!…।-–—")
    if (m := _SPELT.search(core)) and len(m.group()) >= len(core) - 2:
        core = re.sub(r"[-.*_·~+|/\\,]", "", core)
    core = _LONG.sub(r"\1", core).lower()
    letters = sum(c.isalpha() for c in core)
    if _MASK.fullmatch(core):
        return ("*" + re.sub(r"[#%&^]", "*", core),), ends
    if letters >= 2 and len(core) - letters <= 2 and re.search(r"[$@0134578!|]", core) and re.match(r"^[\w$@!|]+$", core):
        core = core.translate(SIGNS)
    return tuple(_WORD.findall(core)), ends


class Words:
    """Normalised chunks and the hashes of words, each computed once."""

    def __init__(self, room: int = 400_000):
        self.room = room
        self.chunks: dict[str, tuple[tuple[str, ...], bool]] = {}
        self.hashes: dict[str, tuple[int, int]] = {}

    def chunk(self, chunk: str) -> tuple[tuple[str, ...], bool]:
        found = self.chunks.get(chunk)
        if found is None:
            if len(self.chunks) > self.room:
                self.chunks.clear()
                self.hashes.clear()
            found = self.chunks[chunk] = normal_words(chunk)
        return found

    def hash(self, word: str) -> tuple[int, int]:
        """Of the word, and of its outline: first and last letter and length."""
        found = self.hashes.get(word)
        if found is None:
            bare = word[1:] if word[0] == "*" else word
            outline = f"~{bare[0]}{len(bare)}{bare[-1]}" if len(bare) >= 3 else word
            name = "*" if word[0] == "*" else word
            found = self.hashes[word] = (xxhash.xxh3_64_intdigest(name), xxhash.xxh3_64_intdigest(outline))
        return found

    def sentences(self, text: str) -> list[list[str]]:
        out: list[list[str]] = []
        chunk = self.chunks.get
        for line in text.splitlines():
            now: list[str] = []
            if " " in line and _APART.search(line):
                line = _APART.sub(lambda m: m.group().replace(" ", ""), line)
            for c in line.split():
                found = chunk(c) or self.chunk(c)
                now += found[0]
                if found[1] or len(now) >= LONGEST_SENTENCE:
                    if now:
                        out.append(now)
                    now = []
            if now:
                out.append(now)
        return out


_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


def places(words: np.ndarray, outlines: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of words in a row: (place, sentence) of each; none crosses a sentence."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        parts, owner = [words * _STEPS[0], outlines * _STEPS[1] + np.uint64(1)], [sentence, sentence]
        same = sentence[1:] == sentence[:-1]
        parts.append((words[:-1] * _STEPS[2] + words[1:] * _STEPS[0])[same])
        parts.append((outlines[:-1] * _STEPS[3] + words[1:] * _STEPS[4])[same])
        parts.append((words[:-1] * _STEPS[4] + outlines[1:] * _STEPS[3] + np.uint64(2))[same])
        owner += [sentence[1:][same]] * 3
        same = sentence[2:] == sentence[:-2]
        parts.append((words[:-2] * _STEPS[5] + words[1:-1] * _STEPS[2] + words[2:] * _STEPS[3])[same])
        parts.append((words[:-2] * _STEPS[1] + words[2:] * _STEPS[5] + np.uint64(3))[same])
        owner += [sentence[2:][same]] * 2
        flat = np.concatenate(parts)
        flat ^= flat >> np.uint64(29)
        flat = (flat * _STEPS[4]) >> np.uint64(64 - BITS)
    return flat.astype(np.int64), np.concatenate(owner)


def sentence_row(words: list[str], held: Words) -> np.ndarray:
    pairs = [held.hash(w) for w in words]
    h, o = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    return np.unique(places(h, o, np.zeros(len(words), np.int64))[0])


_FRAME = re.compile(r"\b(?:all|those|these|against|every one of the|kind of) ((?:[a-z]+(?:-[a-z]+)? )?[a-z]{4,}s)\b(?! of\b)")


def groups_in(texts: list[str], least: int = 3) -> list[str]:
    """Terms for groups: the general ones, and plurals that texts put where groups stand (all ..., those ...,
    against ...), in ``least`` texts or more."""
    seen: dict[str, int] = {}
    for text in texts:
        for term in set(_FRAME.findall(text.lower())):
            seen[term] = seen.get(term, 0) + 1
    return GROUPS + sorted(t for t, n in seen.items() if n >= least and t not in GROUPS)


class Swapper:
    """Puts other terms for groups, persons and places into sentences."""

    def __init__(self, groups: list[str], names: set[str]):
        self.groups = [tuple(w for w in _WORD.findall(g)) for g in groups]
        self.by_first: dict[str, list[tuple[str, ...]]] = {}
        for g in self.groups:
            self.by_first.setdefault(g[0], []).append(g)
        self.names, self.pool = names, sorted(names)

    def __call__(self, words: list[str], rng: random.Random) -> list[str] | None:
        """The sentence with other terms; None if it has none."""
        out, i, done = [], 0, False
        while i < len(words):
            met = max((g for g in self.by_first.get(words[i], ()) if tuple(words[i : i + len(g)]) == g), key=len, default=None)
            if met:
                out += rng.choice(self.groups)
                i += len(met)
                done = True
            elif words[i] in self.names:
                out.append(rng.choice(self.pool))
                i += 1
                done = True
            else:
                out.append(words[i])
                i += 1
        return out if done else None


def names_in(texts: list[str]) -> set[str]:
    """Words that stand capitalised inside sentences and hardly ever in small letters."""
    big: dict[str, int] = {}
    small: dict[str, int] = {}
    for text in texts:
        for w in re.findall(r"(?<=[a-z,] )[A-Z][a-z]{2,}\b", text):
            big[w.lower()] = big.get(w.lower(), 0) + 1
        for w in re.findall(r"\b[a-z]{3,}\b", text):
            small[w] = small.get(w, 0) + 1
    return {w for w, n in big.items() if n > 4 * small.get(w, 0)}


def fit(labelled: list[tuple[str, float, float]], rounds: int = 3, tie: float = 0.3, seed: int = 5) -> Logistic:
    """The model from (text, label, weight) of documents; labels between 0 and 1."""
    rng = random.Random(seed)
    held = Words()
    swap = Swapper(groups_in([t for t, _, _ in labelled]), names_in([t for t, _, _ in labelled]))
    docs = [(held.sentences(t), y >= 0.5, w) for t, y, w in labelled]
    docs = [d for d in docs if d[0]]
    model = Logistic(BITS)
    if not any(y for _, y, _ in docs) or all(y for _, y, _ in docs):
        model.b = -5.0
        return model
    owner = np.array([i for i, d in enumerate(docs) for _ in d[0]])
    plain = [s for d in docs for s in d[0]]
    rows = [sentence_row(s, held) for s in plain]
    everything = Rows(rows)
    positive_doc = np.array([d[1] for d in docs])[owner]
    weight = np.array([d[2] for d in docs])[owner]
    pairs_a, pairs_b = [], []
    for s, r in zip(plain, rows):
        other = swap(s, rng)
        if other:
            pairs_a.append(r)
            pairs_b.append(sentence_row(other, held))
    pairs = (Rows(pairs_a), Rows(pairs_b))
    # The first guess: how much more often the parts of a sentence stand in positive documents.
    seen = np.zeros((2, 1 << BITS))
    for label in (0, 1):
        for i in np.flatnonzero(np.array([d[1] for d in docs]) == bool(label)):
            seen[label, np.unique(np.concatenate([rows[j] for j in range(*np.searchsorted(owner, [i, i + 1]))]))] += 1
    n0, n1 = (~positive_doc).any() and len({*owner[~positive_doc]}), len({*owner[positive_doc]})
    guess = np.log((seen[1] + 0.2) / (n1 + 0.4)) - np.log((seen[0] + 0.2) / (n0 + 0.4))
    guess = np.where(seen[1] + seen[0] >= 2, guess, 0)
    score = everything.scores(guess, 0.0) / np.sqrt(np.maximum(1, np.diff(everything.at)))
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    worst = np.maximum.reduceat(score, first[:-1])
    bar = np.quantile(worst[[not y for _, y, _ in docs]], 0.9)  # what innocent documents rarely reach
    half = np.random.default_rng(seed).integers(0, 2, len(docs))[owner]
    for turn in range(rounds):
        y = np.zeros(len(rows))
        use = np.ones(len(rows), bool)
        # A negative label may be wrong, but few are: a sentence that many such documents have is innocent.
        worst = np.maximum.reduceat(score, first[:-1])
        doubt = max(2.0, float(np.quantile(worst[[not y for _, y, _ in docs]], 0.97)))
        for i, (_, positive, _) in enumerate(docs):
            a, b = first[i], first[i + 1]
            if positive:  # none of its sentences may be reached: a label may be wrong
                top = score[a:b].max()
                chosen = a + np.flatnonzero(score[a:b] > 0 if turn else (score[a:b] == top) & (top > bar))
                use[a:b] = False
                y[chosen] = 1
                use[chosen] = True
            elif turn:
                use[a:b] = score[a:b] < doubt

        def trained(keep: np.ndarray, y: np.ndarray = y) -> Logistic:
            w = weight[keep]
            chosen = Rows([rows[j] for j in keep])
            return Logistic(BITS).fit(chosen, y[keep], w / w.mean(), epochs=3, rate=0.25, l2=1e-5, batch=512, pairs=pairs, tie=tie, seed=seed)

        if turn == rounds - 1:
            return trained(np.flatnonzero(use))
        # Each half is judged by a model of the other, which cannot know its sentences by heart.
        for side in (0, 1):
            keep = np.flatnonzero(use & (half != side))
            if 0 < y[keep].sum() < len(keep):
                other = trained(keep)
                score = np.where(half == side, everything.scores(other.w, other.b), score)
    return model


def training_rows(documents: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, float, float]]:
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("y"), F.count(F.lit(1)).alias("n"))
    chosen = bounded_sample(votes, "doc_id", most)
    rows = documents.select("doc_id", "text").where("trim(text) <> ''").join(chosen, "doc_id").select("doc_id", "text", "y", "n").collect()
    return [(r.text, r.y, 0.3 if 0 < r.y < 1 else 1.0 if r.n == 1 else 1.5) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def scored(documents: DataFrame, labels: DataFrame, most: int = FIT_LABELS, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``also`` and ``score`` (0 to 1) of every document."""
    model = fit(training_rows(documents, labels, most))
    used = np.flatnonzero(model.w)
    shared = documents.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.w[used].astype(np.float32), model.b))
    kept = documents.select("doc_id", *also, "text")
    schema = kept.drop("text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias = shared.value
        w = np.zeros(1 << BITS, np.float32)
        w[used] = weights
        held = Words()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            worst = np.full(len(texts), -np.inf)
            hashes, sizes, docs = [], [], []

            def flush(hashes=hashes, sizes=sizes, docs=docs, worst=worst) -> None:
                if not sizes:
                    return
                flat = np.array(hashes, np.uint64)
                sentence = np.repeat(np.arange(len(sizes)), sizes)
                place, owner = places(flat[0::2], flat[1::2], sentence)
                z = np.bincount(owner, w[place], minlength=len(sizes)) + bias
                np.maximum.at(worst, np.array(docs), z)
                for x in (hashes, sizes, docs):
                    x.clear()

            get = held.hashes.get
            for i, text in enumerate(texts):
                if not text:
                    continue
                for words in held.sentences(text):
                    for word in words:
                        hashes += get(word) or held.hash(word)
                    sizes.append(len(words))
                    docs.append(i)
                if len(hashes) > 400_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sigmoid(np.maximum(worst, -35)) * (worst > -np.inf))], schema.names)

    return kept.mapInArrow(run, schema)


def to_review(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(documents, labels).where(F.col("score") > threshold).select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each source its documents, those to be reviewed and their share."""
    marked = scored(documents, labels, also=("source",))
    return (
        marked.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > threshold).alias("n_flagged"))
        .withColumn("rate", F.col("n_flagged") / F.col("n"))
    )
