"""Problem 2: spellings of one case, act or court.

1. Each distinct string is parsed into a *form*: the tokens of its one or two parts and a tag that
   must agree (the round of a case, the year of an act). Strings with one form are one thing.
2. Tokens meet through a symmetric-delete index: a token stands in it under itself and under every
   spelling with one or, from six letters on, two letters less; initials, short forms and beginnings
   meet the words they may stand for. Of two tokens that can be one, the rarer stands under the other.
   Forms meet by a token; where a list is long, by two tokens, by three ... (see ``_met``). Forms that
   agree in nothing but initials and two-letter short forms meet by those.
3. Pairs that meet are verified by the cheapest assignment of their tokens: a token may differ by a
   spelling mistake, be an initial, a short form or a known other form of its partner.
4. Full forms that match are joined into components. A form that may stand for several things (with
   initials, without the year, shortened, an acronym) is attached only if all full forms it fits lie
   in one component; those that fit none join one another.

Defined results. Null, empty and blank strings and strings that name nothing in particular pair with
none. Repeated rows count once. Very long strings are parsed whole. Empty tables give no pairs. Other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.components import components
from lexquarry.session import settle

#: A list is compared as it is if at most the square of this many pairs meet in it.
HOT = 64

# Short and other forms of first names.
SAME_NAME = {
    "joe": "joseph", "jos": "joseph", "laxmi": "lakshmi", "subbu": "subramaniam", "subramanian": "subramaniam", "rob": "robert", "bob": "robert", "robt": "robert",
    "katherine": "catherine", "kate": "catherine", "cathy": "catherine", "kathy": "catherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "elisabeth": "elizabeth", "thos": "thomas", "tom": "thomas", "mohd": "mohammed", "md": "mohammed", "mohammad": "mohammed", "muhammad": "mohammed", "mohamed": "mohammed",
    "will": "william", "bill": "william", "wm": "william", "raju": "rajendra", "rajinder": "rajendra", "yash": "yashwant", "yeshwant": "yashwant", "gopal": "gopalakrishnan",
    "chandra": "chandrasekhar", "chandrashekhar": "chandrasekhar", "chandrashekar": "chandrasekhar", "vicky": "vikram", "nandu": "nandini", "charu": "charulata",
    "manu": "manohar", "bhasker": "bhaskar", "fathima": "fatima", "sita": "seetha", "geoff": "jeffrey", "jim": "james", "jas": "james", "chas": "charles", "geo": "george",
}
HONORIFICS = {"shri", "smt", "sri", "mr", "mrs", "ms", "dr", "messrs", "m/s", "the", "of", "late", "adv", "prof", "hon", "honble"}
LEGAL_FORMS = {"pvt", "private", "ltd", "limited", "llp", "p"}
# Words that stand for the state as a party.
STATE = {"state", "st", "govt", "government"}
# Strings that name nothing in particular.
NOTHING = {
    "", "act", "said act", "the said act", "ibid", "id", "supra", "as above", "see note", "see above", "n a", "na", "none", "null", "nil", "unknown", "not stated", "not known",
    "tbd", "court", "the court", "this court", "the said court", "case", "the said case", "same", "ditto", "do", "various", "others", "bench of two judges", "the learned counsel",
    "the act", "this act", "principal act", "the principal act", "aforesaid act", "the aforesaid act", "parliament", "?", "-",
}
# Short forms in the names of acts and courts.
ACT_SHORT = {"co": "company", "mun": "municipal", "ins": "insolvency", "comm": "commercial", "elec": "electricity", "coop": "cooperative", "prot": "protection", "reg": "registration"}
COURT_SHORT = {
    "hc": "high court", "sc": "supreme court", "ct": "court", "crt": "court", "trib": "tribunal", "natl": "national", "nat": "national", "app": "appellate",
    "cap": "capital", "mkts": "markets", "mkt": "markets", "comm": "commercial", "comml": "commercial", "fam": "family", "dist": "district", "dc": "district court",
    "lc": "labour court", "labor": "labour", "apex": "supreme", "arb": "arbitration", "fed": "federal", "chmbr": "chamber", "fc": "family court", "cc": "commercial court",
}
COURT_IDLE = {"the", "of", "at", "in", "for", "and", "hon", "ble", "honble", "judicature", "principal", "causes", "judge"}

_TAIL = re.compile(r"(?:[\s,]*(?:&|\band\b)\s*(?:ors|others|anr|another|anor)\b\.?|[\s,]*\betc\b\.?)\s*$", re.I)
_ROUND = re.compile(r"\s*[(\[]\s*(?:no\.?\s*)?(\d{1,3}|[ivx]{1,5})\s*[)\]]\s*$|[\s,]+no\.?\s*(\d{1,3})\s*$|\s+[-–—]\s*(\d{1,3}|[ivx]{1,5})\s*$", re.I)
_VERSUS = re.compile(r"\s+(?:v/s|versus|vs|v)\.?\s+", re.I)
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_DOTTED = re.compile(r"\b(?:[A-Za-z]\.\s?){2,}")
_YEAR = re.compile(r"\b(1[5-9]\d\d|20\d\d)\b|['’](\d\d)\b")


@dataclass(frozen=True)
class Form:
    """``kind``: full, or why it may stand for several things (loose)."""

    a: tuple[str, ...]
    b: tuple[str, ...]
    tag: str
    kind: str

    @property
    def key(self) -> str:
        return "|".join((self.kind, self.tag, " ".join(self.a), " ".join(self.b)))


def near(x: str, y: str, most: int = 1) -> int | None:
    """The number of edits (insert, delete, replace, swap neighbours) between x and y if at most ``most``."""
    if x == y:
        return 0
    if abs(len(x) - len(y)) > most:
        return None
    far = most + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(most + 1)}
    for i, c in enumerate(x, 1):
        now = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(y), i + most) + 1):
            d = y[j - 1]
            best = min(last.get(j, far) + 1, now.get(j - 1, far) + 1, last.get(j - 1, far) + (c != d))
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                best = min(best, before.get(j - 2, far) + 1)
            now[j] = best
        if min(now.values(), default=far) > most:
            return None
        before, last = last, now
    found = last.get(len(y), far)
    return found if found <= most else None


def _is_legal_form(word: str) -> bool:
    if word in LEGAL_FORMS or word in ("lp", "lllp", "ld"):
        return True
    return any(near(word, w) is not None for w in (("limited", "private") if len(word) > 5 else ("ltd", "pvt", "llp") if 2 <= len(word) <= 4 else ()))


def _words(text: str) -> list[str]:
    return re.findall(r"m/s|[^\W_]+", text.lower().replace("-", ""))


def _party(text: str) -> tuple[str, ...]:
    words = _words(_DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text) if "m/s" not in text.lower() else text)
    if any(w in STATE or (len(w) >= 4 and near(w, "state") is not None) for w in words):
        rest = [w for w in words if w not in STATE and not (len(w) >= 4 and near(w, "state") is not None) and w not in HONORIFICS]
        if rest:
            return ("state", *sorted(rest))
    kept = [w for w in words if w not in HONORIFICS]
    named = [w for w in kept if not _is_legal_form(w) or (len(w) == 1 and w == "p" and len(kept) == 2)]
    return tuple(sorted(SAME_NAME.get(w, w) for w in (named or kept)))


def _case(text: str) -> Form | None:
    tag = "1"
    for _ in range(3):
        if m := _ROUND.search(text):
            got = next(g for g in m.groups() if g).lower()
            tag = str(_ROMAN.get(got, got))
            text = text[: m.start()]
        text = _TAIL.sub("", text)
    parts = _VERSUS.split(f" {text} ", maxsplit=1)
    if len(parts) != 2:
        words = tuple(sorted(w for w in _words(text) if w not in HONORIFICS))
        return Form(words, (), tag, "full") if len(words) > 1 else None
    a, b = _party(parts[0]), _party(parts[1])
    if not a or not b:
        return None
    return Form(a, b, tag, "loose" if any(len(w) <= 2 for w in a + b) else "full")


def _act(text: str) -> Form | None:
    year = ""
    if m := _YEAR.search(text):
        year = m.group(1) or m.group(2)
        text = text[: m.start()] + " " + text[m.end() :]
    words = [ACT_SHORT.get(w, w) for w in _words(_DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text))]
    words = [w for w in words if w not in ("the", "act", "acts", "of", "on", "no", "for", "to", "and")]
    if not words:
        return None
    if len(words) == 1 and 3 <= len(words[0]) <= 6 and year and words[0].endswith("a") and text.strip(" ,").isupper():
        return Form((words[0],), (), year, "acronym")
    if len(words) < 2:
        return None
    return Form(tuple(sorted(words)), (), year, "full" if len(year) == 4 else "loose")


def _court(text: str) -> Form | None:
    text = _DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text)
    text = re.sub(r"\(\s*principal bench\s*\)", " ", text, flags=re.I)
    raw = _words(text.replace("'", " ").replace("’", " "))
    words = [w for word in raw for w in COURT_SHORT.get(word, word).split()]
    words = [w for w in words if w not in COURT_IDLE]
    if not words:
        return None
    if len(words) == 1 and 3 <= len(words[0]) <= 5 and text.strip().isupper():
        return Form((words[0],), (), "", "acronym")
    return Form(tuple(sorted(words)), (), "", "full")


_PARSERS = {"case_name": _case, "act_name": _act, "court": _court}


def parse(field: str, text: str) -> Form | None:
    """The form of a string, or None if it names nothing in particular."""
    plain = unicodedata.normalize("NFKC", text)
    plain = " ".join(plain.split())
    if " ".join(re.findall(r"[^\W_]+", plain.lower())) in NOTHING:
        return None
    return _PARSERS[field](plain)


@lru_cache(200_000)
def token_cost(x: str, y: str) -> int | None:
    """What it costs, in tenths, to take x and y for one word; None if they can't be."""
    if x == y:
        return 0
    if x == "state" or y == "state":
        return None
    if x.isdigit() or y.isdigit():
        return None
    short, long = sorted((x, y), key=len)
    if len(short) == 1:
        return 4 if long.startswith(short) else None
    if len(short) == 2:
        return 5 if long[0] == short[0] and short[1] in long[1:] and len(long) > 3 else None
    if len(short) >= 3 and len(long) - len(short) >= 2 and long.startswith(short):
        return 6
    if len(short) < 4:
        return 10 if len(short) == 3 and near(x, y) is not None and x[0] == y[0] else None
    found = near(x, y, 2 if len(short) >= 6 else 1)
    if found == 2 and len(x) == len(y) and sum(c != d for c, d in zip(x, y)) == 2:
        return None  # two other letters make another name more often than two slips
    return None if found is None else 10 * found


def assign(xs: tuple[str, ...], ys: tuple[str, ...]) -> int | None:
    """The least total cost, in tenths, of an assignment of all tokens of the two sides, None if there is none.

    Equal tokens start as partners; each other token then takes the cheapest way to a free one, on which
    partners may change: K. Kumar and Kiran K. agree only if neither k stays with the other.
    """
    if len(xs) != len(ys):
        return None
    place: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        place.setdefault(y, []).append(j)
    own = {i: place[x].pop() for i, x in enumerate(xs) if place.get(x)}  # by left token its right one
    if len(xs) - len(own) > 7:  # tokens that differ cost 4 at least, and no total above 30 is accepted
        return None
    taken = {j: i for i, j in own.items()}
    total = 0
    for i in [k for k in range(len(xs)) if k not in own]:
        left, right, via, open_ = {i: 0}, {}, {}, [i]
        while open_:
            u = open_.pop(0)
            for j, y in enumerate(ys):
                if own.get(u) != j and (c := token_cost(xs[u], y)) is not None and left[u] + c < right.get(j, 1_000_000):
                    right[j], via[j] = left[u] + c, u
                    v = taken.get(j)
                    if v is not None and right[j] - token_cost(xs[v], y) < left.get(v, 1_000_000):
                        left[v] = right[j] - token_cost(xs[v], y)
                        open_.append(v)
        j = min((k for k in right if k not in taken), key=right.__getitem__, default=None)
        if j is None:
            return None
        total += right[j]
        while j is not None:
            u = via[j]
            j_before = own.get(u)
            own[u], taken[j] = j, u
            j = j_before
    return total


def _most(n: int) -> int:
    """The total cost, in tenths, that n tokens may have: two spellings of one thing may both be wrong."""
    return 20 if n <= 2 else 30


def match(field: str, x: Form, y: Form) -> bool:
    """Whether two forms can name one thing."""
    if "acronym" in (x.kind, y.kind):
        if x.kind == y.kind:
            return x == y
        short, long = (x, y) if x.kind == "acronym" else (y, x)
        return field != "case_name" and _initials(field, short.a[0], long.a) and (field == "court" or _years(short.tag, long.tag))
    if field == "case_name":
        if x.tag != y.tag:
            return False
        a, b = assign(x.a, y.a), assign(x.b, y.b)
        return a is not None and b is not None and a + b <= _most(len(x.a) + len(x.b))
    if field == "act_name" and not _years(x.tag, y.tag):
        return False
    cost = assign(x.a, y.a)
    if cost is not None:
        return cost <= _most(len(x.a))
    if field == "act_name" and abs(len(x.a) - len(y.a)) == 1 and min(len(x.a), len(y.a)) >= 2 and len(x.tag) == len(y.tag) == 4:
        long, short = (x.a, y.a) if len(x.a) > len(y.a) else (y.a, x.a)
        return any((c := assign(long[:i] + long[i + 1 :], short)) is not None and c <= 10 for i in range(len(long)))
    return False


def _years(x: str, y: str) -> bool:
    return x == y or not x or not y or (len(x) != len(y) and x[-2:] == y[-2:])


def _initials(field: str, short: str, words: tuple[str, ...]) -> bool:
    letters = sorted(w[0] for w in words) + (["a"] if field == "act_name" else [])
    return sorted(short) == sorted(letters)


#: The longest token whose spellings with two letters less are listed; longer ones meet by segments.
_LISTED = 22
_SEGMENTS = 5
#: Keys of so many tokens are compared whatever the length of their lists.
_DEEPEST = 60


def _spellings(word: str) -> set[str]:
    """The word, its spellings with a letter less, and from six letters on those with two letters less."""
    out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= 6:
        out |= {v[:i] + v[i + 1 :] for v in list(out) if len(v) < len(word) for i in range(len(v))}
    return out


def _segments(n: int) -> list[tuple[int, int]]:
    """Where the segments of a word of n letters begin and end."""
    return [(n * k // _SEGMENTS, n * (k + 1) // _SEGMENTS) for k in range(_SEGMENTS)]


def _neighbourhood(word: str) -> Iterator[tuple[int, int]]:
    """Rows (role, key) of a token in the token index. Tokens that :func:`token_cost` takes for one share a
    key in role 0, or have it in the roles 1 and 2.

    Two edits leave one of five segments as it is, at most two places off, a swap over a border included.
    """
    key = xxhash.xxh3_64_intdigest
    n = len(word)
    yield 1, key("p" + word)
    if word.isdigit():
        return
    if 3 <= n <= _LISTED:
        for v in _spellings(word):
            yield 0, key("d" + v)
    if n >= _LISTED - 3:
        for k, (a, b) in enumerate(_segments(n)):
            yield 1, key(f"s{n}.{k}.{word[a:b]}")
        for other in range(max(n - 2, _LISTED - 3), n + 3):
            for k, (a, b) in enumerate(_segments(other)):
                for v in {word[c : c + b - a] for c in range(max(0, a - 2), min(n - (b - a), a + 2) + 1)}:
                    yield 2, key(f"s{other}.{k}.{v}")
    if n >= 2:
        yield 2, key("p" + word[0])
    if n > 3:
        for c in set(word[1:]):
            yield 2, key("p" + word[0] + c)
    rolling = xxhash.xxh3_64("p" + word[:2])
    for c in word[2 : n - 2]:
        rolling.update(c)
        yield 2, rolling.intdigest()


def _parsed(names: DataFrame) -> DataFrame:
    """``form`` of each name, its tokens with the part they are in, of each where it first stands (``units``) and how
    often before, what must agree between forms that match (``alike``), and the letters by which acronyms meet it."""
    schema = "field_name string, name string, form string, kind string, tokens array<string>, units array<int>, copies array<int>, alike string, letters string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for field, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = parse(field, name)
                if form:
                    alike = {"case_name": f"{form.tag}|{len(form.a)}|{len(form.b)}", "court": f"{len(form.a)}"}.get(field, "")
                    tokens = [f"{part}{w}" for part, words in enumerate((form.a, form.b)) for w in words if w != "state"]
                    letters = None
                    if form.kind == "acronym":
                        tokens, letters = [], "".join(sorted(form.a[0]))
                    elif field != "case_name":
                        letters = "".join(sorted([w[0] for w in form.a] + (["a"] if field == "act_name" else [])))
                    first: dict[str, int] = {}
                    seen: Counter[str] = Counter()
                    units, copies = [], []
                    for k, w in enumerate(tokens):
                        units.append(first.setdefault(w, k))
                        copies.append(seen[w])
                        seen[w] += 1
                    rows.append((field, name, form.key, form.kind, tokens, units, copies, alike, letters))
            numbers = pa.list_(pa.int32())
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), numbers, numbers, pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["field_name", "name", "form", "kind", "tokens", "units", "copies", "alike", "letters"])

    return names.mapInArrow(run, schema)


def _kin(tokens: DataFrame) -> DataFrame:
    """Of each token (columns field_name, no, token, n) the keys it stands under: field, token, key, ``own`` (the
    key is the token itself) and ``start`` (the key is long enough to bring forms together by itself).

    Of two tokens that can be one, the rarer stands under the more frequent, a longer one under an initial.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, role, key = [], [], []
            for i, word in enumerate(batch.column(2).to_pylist()):
                for r, k in _neighbourhood(word):
                    row.append(i)
                    role.append(r)
                    key.append(k)
            pick = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(role, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))],
                ["field_name", "no", "role", "key"],
            )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for field, x, nx, y, ny in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if token_cost(x, y) is not None:
                    short, long = sorted((x, y), key=len)
                    if len(short) < 3:
                        out.append((field, long, short))
                    else:
                        out.append((field, x, y) if (nx, x) < (ny, y) else (field, y, x))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.string()) for j in range(3)], ["field_name", "token", "key"])

    index = settle(tokens.select("field_name", "no", "token").mapInArrow(post, "field_name string, no long, role int, key long"), "tokens")
    left = index.select("field_name", "key", "role", F.col("no").alias("i"))
    right = index.select("field_name", "key", F.col("role").alias("r"), F.col("no").alias("j"))
    both = left.where("role = 0").join(right.where("r = 0"), ["field_name", "key"]).where("i < j").select("i", "j")
    ends = left.where("role = 1").join(right.where("r = 2"), ["field_name", "key"]).where("i <> j")
    pairs = both.unionByName(ends.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))).distinct()
    x = tokens.select("field_name", F.col("no").alias("i"), F.col("token").alias("x"), F.col("n").alias("nx"))
    y = tokens.select(F.col("no").alias("j"), F.col("token").alias("y"), F.col("n").alias("ny"))
    pairs = pairs.join(x, "i").join(y, "j").select("field_name", "x", "nx", "y", "ny")
    kin = pairs.mapInArrow(check, "field_name string, token string, key string")
    own = tokens.select("field_name", "token", F.col("token").alias("key"), F.lit(True).alias("own"))
    return own.unionByName(kin.withColumn("own", F.lit(False))).withColumn("start", F.length("key") >= 3)


def _lists(rows: DataFrame, depth: int, hot: int) -> DataFrame:
    """``rows`` of an index with a verdict on each list: ``lead``, the evidence that fewest rows have as their
    own, and ``long``, whether more than ``hot`` squared pairs would be compared by it."""
    keys = ["field_name", "alike", "key"]
    own = [F.sum(F.when(F.expr(f"(away & {1 << k}) = 0"), 1).otherwise(0)).alias(f"own{k}") for k in range(depth)]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *own)
    fewest = F.least(*(F.col(f"own{k}") for k in range(depth))) if depth > 1 else F.col("own0")
    lead = F.lit(0)
    for k in range(depth - 1, 0, -1):
        lead = F.when(F.col(f"own{k}") == fewest, F.lit(k)).otherwise(lead)
    sizes = sizes.select(*keys, lead.alias("lead"), (fewest * F.col("n") > hot * hot).alias("long")).where(fewest > 0)
    return rows.join(sizes, keys)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Forms of one list of which no evidence is away from its key in both."""
    keys = ["field_name", "alike", "key"]
    left = left.select(*keys, F.col("form_no").alias("x"), F.col("away").alias("x_away"))
    right = right.select(*keys, F.col("form_no").alias("y"), F.col("away").alias("y_away"))
    met = left.join(right, keys).where("x <> y and (x_away & y_away) = 0")
    return met.select("field_name", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _met(forms: DataFrame, hot: int) -> DataFrame:
    """Pairs of forms with a token that can be one in both, and no proof yet that others cannot.

    A list by which too many pairs would meet is taken apart by a second token, then by a third ...: two forms
    that match agree in all tokens, so they share the longer key too. It is compared as it is, against the
    forms that have no token left, only where tokens have run out. The pairs that pass :func:`match` are the
    same for every ``hot``.
    """
    each = F.explode(F.arrays_zip("tokens", "units", "copies"))
    places = forms.select("field_name", "form_no", "alike", F.size("tokens").alias("many"), each.alias("t"))
    part, token = F.substring("t.tokens", 1, 1), F.expr("substring(t.tokens, 2)")
    places = places.select("field_name", "form_no", "alike", "many", part.alias("part"), token.alias("token"), F.col("t.units").alias("unit"), F.col("t.copies").alias("copy"))
    words = places.groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("no", F.monotonically_increasing_id())
    kin = settle(_kin(settle(words, "words")), "kin")
    evidence = places.join(kin, ["field_name", "token"])
    evidence = evidence.select("field_name", "form_no", "alike", "many", "unit", "copy", F.concat("part", "key").alias("key"), "own", "start")
    evidence = settle(evidence, "evidence")
    away = F.when(F.col("own"), 0).otherwise(1).cast("long")
    rank = F.concat(F.when(F.col("start"), "0").otherwise("1"), "key")
    # Keys under three letters are a start only for pairs that agree in no longer one. In these no long token has a long
    # partner, so the long tokens of both are no more than the tokens assigned (an act may leave one out).
    long_tokens = forms.select("field_name", "form_no", "alike", F.expr("size(filter(tokens, w -> length(w) > 3))").alias("l"), F.size("tokens").alias("k"))
    fewest = long_tokens.where("k > 0").groupBy("field_name", "alike").agg(F.min("l").alias("least"))
    spare = F.when(F.col("field_name") == "act_name", 1).otherwise(0)
    brief = long_tokens.join(fewest, ["field_name", "alike"]).where((F.col("l") + F.col("least") <= F.col("k") + spare) & (F.col("l") <= 8))
    first = evidence.where("start").unionByName(evidence.where("not start").join(brief.select("form_no"), "form_no", "left_semi"))
    rows = first.where("copy = 0").select(
        "field_name", "form_no", "alike", "many", "key", away.alias("away"), rank.alias("last"), F.array("unit").alias("used")
    )
    found, depth, others = [], 1, None
    while True:
        rows = settle(_lists(rows, depth, hot), "lists")
        few = rows.where("not long")
        found.append(_pairs(few.where("(away & shiftleft(1L, lead)) = 0"), few))
        if rows.where("long").isEmpty():
            break
        long = rows.where("long")
        if depth == _DEEPEST:
            found.append(_pairs(long, long))
            break
        found.append(_pairs(long.where("size(used) = many"), long))
        if others is None:
            # What can prolong a key: tokens whose own lists are long (by the others the pair meets anyway) and short ones.
            next_ = evidence.select("field_name", "form_no", "unit", "copy", F.col("key").alias("next"), away.alias("next_away"), rank.alias("rank"), "start", "alike")
            hot_keys = long.select("field_name", "alike", F.col("key").alias("next")).distinct()
            others = next_.where("not start").unionByName(next_.where("start").join(hot_keys, ["field_name", "alike", "next"], "left_semi"))
            others = settle(others.drop("alike", "start"), "others")
        longer = long.join(others, ["field_name", "form_no"]).where("rank >= last and copy = size(filter(used, u -> u = unit))")
        rows = longer.select(
            "field_name", "form_no", "alike", "many", F.concat_ws(" ", "key", "next").alias("key"),
            F.col("away").bitwiseOR(F.col("next_away") * F.lit(1 << depth)).alias("away"), F.col("rank").alias("last"),
            F.array_append("used", F.col("unit")).alias("used"),
        )
        depth += 1
    acronyms = forms.where("kind = 'acronym'").select("field_name", "letters", F.col("form_no").alias("x"))
    spelt = forms.where("kind <> 'acronym' and letters is not null").select("field_name", "letters", F.col("form_no").alias("y"))
    pairs = acronyms.join(spelt, ["field_name", "letters"]).select("field_name", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    for one in found:
        pairs = pairs.unionByName(one)
    x, y = (forms.select(F.col("form_no").alias(c), F.col("form").alias(f"{c}_form")) for c in "xy")
    return pairs.distinct().join(x, "x").join(y, "y").select("field_name", F.col("x_form").alias("x"), F.col("y_form").alias("y"))


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs of forms that match; ``full`` tells whether both are full forms of equal detail."""
    schema = "field_name string, x string, y string, firm boolean"

    def read(key: str) -> Form:
        kind, tag, a, b = key.split("|")
        return Form(tuple(a.split()), tuple(b.split()), tag, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for field, kx, ky in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, y = read(kx), read(ky)
                if match(field, x, y):
                    firm = x.kind == y.kind == "full" and len(x.a) == len(y.a) and len(x.b) == len(y.b)
                    out.append((field, kx, ky, firm))
            columns = [pa.array([r[i] for r in out], pa.bool_() if i == 3 else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["field_name", "x", "y", "firm"])

    return pairs.select("field_name", "x", "y").mapInArrow(run, schema)


def entities(names: DataFrame, hot: int = HOT) -> DataFrame:
    """field_name, name and ``entity`` of each distinct string that names something."""
    names = names.select("field_name", "name").where("trim(name) <> ''").distinct()
    parsed = settle(_parsed(names), "parsed")
    forms = parsed.drop("name").dropDuplicates(["field_name", "form"])
    forms = settle(forms.withColumn("form_no", F.monotonically_increasing_id()), "forms")
    links = settle(_verified(_met(forms, hot)), "links")
    key = lambda c: F.concat_ws(":", "field_name", c)
    firm = components(links.where("firm").select(key("x").alias("a"), key("y").alias("b")))
    base = forms.select(key("form").alias("node"), "kind").join(firm, "node", "left")
    base = settle(base.select("node", "kind", F.coalesce("component", "node").alias("component")), "base")
    # Forms that may stand for several things: the components of the forms of greater detail they fit.
    loose = links.where("not firm").select(key("x").alias("p"), key("y").alias("q"))
    both = loose.unionByName(loose.select(F.col("q").alias("p"), F.col("p").alias("q")))
    detail = lambda c: F.size(F.split(c, r"[ |]+"))
    up = both.join(base.select(F.col("node").alias("q"), F.col("component").alias("to"), F.col("kind").alias("to_kind")), "q")
    up = up.join(base.select(F.col("node").alias("p"), F.col("kind").alias("from_kind")), "p")
    up = up.where((F.col("to_kind") == "full") & ((F.col("from_kind") != "full") | (detail("p") < detail("q"))))
    home = up.groupBy("p").agg(F.min("to").alias("to"), F.max("to").alias("other")).where("to = other").select(F.col("p").alias("node"), "to")
    placed = base.join(home, "node", "left").groupBy("component").agg(F.min("to").alias("to"), F.max("to").alias("other"), F.collect_set("kind").alias("kinds"))
    moved = placed.where("to is not null and to = other").select("component", "to")
    # Those that fit no form of greater detail still join one another.
    lone = base.where("kind = 'loose'").join(up.select(F.col("p").alias("node")).distinct(), "node", "left_anti").select("node")
    among = loose.join(lone.withColumnRenamed("node", "p"), "p").join(lone.withColumnRenamed("node", "q"), "q")
    peers = components(among.select(F.col("p").alias("a"), F.col("q").alias("b"))).withColumnRenamed("component", "peer")
    final = base.join(moved, "component", "left").join(peers, "node", "left")
    final = final.select("node", F.coalesce("to", "peer", "component").alias("entity"))
    return parsed.withColumn("node", key("form")).join(final, "node").select("field_name", "name", "entity")


def variant_pairs(names: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs of different strings of one field that name the same thing, the smaller first."""
    named = settle(entities(names, hot), "entities")
    a, b = named.withColumnRenamed("name", "name_a"), named.withColumnRenamed("name", "name_b")
    return a.join(b, ["field_name", "entity"]).where("name_a < name_b").select("field_name", "name_a", "name_b")


def names_of(citations: DataFrame) -> DataFrame:
    parts = [citations.select(F.lit(f).alias("field_name"), F.col(f).alias("name")) for f in ("case_name", "act_name", "court")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def variant_groups(names: DataFrame, hot: int = HOT) -> DataFrame:
    """Each distinct string that names something, with ``entity``, the least string of all that name the
    same, and ``links``, how many others there are."""
    named = settle(entities(names, hot), "entities")
    sizes = named.groupBy("field_name", "entity").agg(F.min("name").alias("least"), (F.count(F.lit(1)) - 1).alias("links"))
    return named.join(sizes, ["field_name", "entity"]).select("field_name", "name", F.col("least").alias("entity"), "links")
