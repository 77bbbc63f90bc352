"""Problem 4: records that share most of their words.

Two texts of m and n words are near copies when 2c >= t(m + n), c being the words in common with
repeats counted. A record is a sparse vector of bytes over hashed word positions: the byte at a
word's position says how often the word stands in it. The index holds positional bytes, one for
every step of a count (word, 1), (word, 2) ..., so the number of shared positional bytes of two
records is exactly c. Count filtering keeps it small and loses nothing:

* With all positional bytes in one global order, rare words first, near copies share one of the
  first m - need + 1 of the one and n - need + 1 of the other, need = ceil(t(m + n) / 2). Only
  these are indexed, and the place in the order and the lengths rule out most partners in a list.
* Each record also has a signature of ``BITS`` one-bit positions, the parity of its positional bytes
  there. Records that differ in d words differ in d positions at most, so the equal positions of near
  copies are tallied and must reach BITS - (m + n - 2 need).

What passes is verified on the whole vectors. Lists of frequent words are cut into cells by length: a
record stands in the cell of its own length and, as the shorter, in those of the lengths that its place
leaves to partners. Frequent words are late in the order, so these are few however long the list is. Only
the longest lists are cut by random parts too. A word outside the ordered ones counts as often as the
rarest of them, which is its bound. Equal texts, told apart by 128-bit hashes, are one record with a number
of its own until the end; ordered words are told apart by their place, others within a vector by 64-bit hashes.

Defined results. Null text: no record. Texts under ``least`` words pair with none. Empty tables give
no rows. A record delivered again with the same text is one record. Very long texts are compared
whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.components import components
from lexquarry.llm.frequent import most_frequent
from lexquarry.session import settle

_WORD = re.compile(r"[^\W_]+")
#: Positions of a signature, 64 in each of its columns.
BITS = 128
_SIGNS = [f"s{j}" for j in range(BITS // 64)]
#: Lists of words that occur more often than this are cut into cells: one more for each doubling of the length
#: whenever they occur as often again, up to ``_STEPS``, and by random parts beyond each ``_PART`` times.
CELL = 65_536
_STEPS, _PART = 8, 128
#: The words whose order is by measured frequency; all rarer ones come before them, by hash.
ORDERED_WORDS = 20_000
#: Occurrences of an ordered word in one text that its number can tell; those beyond are held as rare words are.
_TIMES = 65_536
#: Lists up to this size are compared all at one time, longer ones in blocks of so many by so many rows.
_FEW = 48
_BLOCK, _SPAN = 16, 4096
#: Words a worker remembers between batches.
_HELD = 500_000
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower()) if "İ" not in text else [w.lower() for w in _WORD.findall(text)]


def word_counts(records: DataFrame) -> DataFrame:
    """``word`` and ``n``, its number of occurrences in the column ``text`` of all records."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_words(text))
            if len(seen) > _HELD:
                yield from rows(seen)
                seen = Counter()
        yield from rows(seen)

    def rows(seen: Counter[str]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return records.select("text").where("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _need(m, n, t: float):
    """The words that texts of m and n words must share."""
    return np.ceil(t * (np.asarray(m) + n) / 2 - 1e-9).astype(np.int64)


class _Codes(dict):
    """Numbers of the words seen, with the place in the order and hash of each."""

    def __init__(self, places: dict[str, int]):
        self.places = places
        self.place, self.hash = array("q"), array("Q")

    def __missing__(self, word: str) -> int:
        self.place.append(self.places.get(word, 0))
        self.hash.append(xxhash.xxh3_64_intdigest(word))
        code = self[word] = len(self)
        return code


def _index_order(record: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by record, place and hash: by one packed number where that tells all apart."""
    low = int(place.max()).bit_length()
    spare = 64 - low - int(record[-1]).bit_length()
    if spare > 24:
        packed = (record.astype(np.uint64) << np.uint64(low) | place.astype(np.uint64)) << np.uint64(spare) | hashes >> np.uint64(64 - spare)
        at = np.argsort(packed)
        packed, sorted_hashes = packed[at], hashes[at]
        if not ((packed[1:] == packed[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])).any():
            return at
    return np.lexsort((hashes, place, record))


def vectors(records: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """Of each distinct text of a table: ``rid``, its length ``m``, signature and positional bytes in index order,
    those of words that have no place as hashes (``rare``), then the others as ``_TIMES`` * place + step (``often``).
    Besides, by place, how often its word fills a cell, begun ones counted."""
    spark = records.sparkSession
    common = most_frequent(word_counts(records), ORDERED_WORDS)
    filled = np.array([common[-1].n if common else 1] + [r.n for r in reversed(common)])
    shared = spark.sparkContext.broadcast({r.word: len(common) - i for i, r in enumerate(common)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value)
        for batch in batches:
            if len(codes) > _HELD:
                codes = _Codes(shared.value)
            words, keep, sizes = [], [], []
            for i, text in enumerate(batch.column(4).to_pylist()):
                own = _words(text)
                if len(own) >= least:
                    words += own
                    keep.append(i)
                    sizes.append(len(own))
            if not keep:
                continue
            code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            place, hashes = (np.array(x)[code] for x in (codes.place, codes.hash))
            record = np.repeat(np.arange(len(keep)), sizes)
            at = _index_order(record, place, hashes)
            hashes, place = hashes[at], place[at]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (record[1:] != record[:-1])])
            row = np.arange(len(hashes))
            step = row - np.maximum.accumulate(np.where(new, row, 0))
            if (beyond := (step >= _TIMES) & (place > 0)).any():
                place = np.where(beyond, 0, place)
                at = np.lexsort((step, hashes, place, record))
                hashes, place, step = hashes[at], place[at], step[at]
            marks = hashes + step.astype(np.uint64) * np.uint64(_MIX)
            where = (marks >> np.uint64(40)).astype(np.int64) % BITS
            parity = (np.bincount(record * BITS + where, minlength=len(keep) * BITS) & 1).astype(np.uint8)
            signed = np.packbits(parity).view(np.int64).reshape(len(keep), len(_SIGNS))
            named = place > 0
            rare, often = (
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(record[own], minlength=len(keep)))]).astype(np.int32)), pa.array(values[own]))
                for own, values in ((~named, marks.view(np.int64)), (named, (place * _TIMES + step).astype(np.int64)))
            )
            pick = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).take(pick) for j in range(4)), pa.array(sizes, pa.int32()), *(pa.array(signed[:, j]) for j in range(len(_SIGNS))),
                 rare, often.cast(pa.list_(pa.int32()))],
                ["table_name", "h0", "h1", "rid", "m", *_SIGNS, "rare", "often"],
            )

    texts = records.where("text is not null").groupBy("table_name", *_text_key()).agg(F.first("text").alias("text"))
    texts = texts.select("table_name", "h0", "h1", F.monotonically_increasing_id().alias("rid"), "text")
    signs = ", ".join(f"{s} long" for s in _SIGNS)
    return texts.mapInArrow(build, f"table_name string, h0 long, h1 long, rid long, m int, {signs}, rare array<long>, often array<int>"), -(-filled // CELL)


def _text_key() -> list:
    """Two columns, the 128 bits that tell texts apart."""
    return [F.xxhash64("table_name", "text").alias("h0"), F.xxhash64("text", F.lit(1), "table_name").alias("h1")]


def _cell(length: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The cell of a length where ``steps`` cells make up each doubling of it; 0 for all lengths without steps."""
    return (steps * np.log2(np.maximum(length, 1)) + 1e-9).astype(np.int64)


def _postings(t: float, cells: np.ndarray):
    """Rows of the index: key, m, rid, place in the order and role (1 as the shorter, 2 as the longer) in one, signature."""
    widest = (2 - t) / t
    e = int(round(t * 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table, rid, m = batch.column(0), batch.column(1), batch.column(2).to_numpy().astype(np.int64)
            signs = [batch.column(3 + j).to_numpy() for j in range(len(_SIGNS))]
            rare, often = batch.column(3 + len(_SIGNS)), batch.column(4 + len(_SIGNS))
            (begin_rare, flat_rare), (begin, flat) = ((c.offsets.to_numpy().astype(np.int64), c.values.to_numpy()) for c in (rare, often))
            without = np.diff(begin_rare)
            salt = {name: xxhash.xxh3_64_intdigest(name) >> 1 for name in set(table.to_pylist())}
            salts = np.array([salt[name] for name in table.to_pylist()], np.int64)
            short = m - _need(m, m, t) + 1
            long = m - _need(np.ceil(m / widest - 1e-9), m, t) + 1
            row = np.repeat(np.arange(len(m)), long)
            place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
            named = place >= without[row]
            key, h = np.zeros(len(row), np.int64), np.full(len(row), cells[0])
            key[~named] = flat_rare[(begin_rare[row] + place)[~named]]
            word = flat[(begin[row] + place - without[row])[named]].astype(np.int64)
            key[named] = (word.astype(np.uint64) * np.uint64(_MIX)).view(np.int64)
            h[named] = cells[word // _TIMES]
            key ^= salts[row]
            role = np.where(place < short[row], 3, 2)
            # A cut list: a cell has the records of its lengths, and as the shorter those that reach such a length.
            steps, length = np.where(h > 1, np.minimum(h, _STEPS), 0), m[row]
            cell = _cell(length, steps)
            top = np.where(role & 1 > 0, np.maximum(length, (2000 * (length - place) - e * length) // e), length)
            copies = _cell(top, steps) - cell
            more = np.repeat(np.arange(len(row)), copies)
            above = np.arange(len(more)) - np.repeat(np.cumsum(copies) - copies, copies) + 1
            cell = np.concatenate([cell, cell[more] + above])
            key, row, place, h = (np.concatenate([c, c[more]]) for c in (key, row, place, h))
            role = np.concatenate([role, np.ones(len(more), np.int64)])
            key = key ^ (cell.astype(np.uint64) * np.uint64(_MIX)).view(np.int64)
            # Parts of the longest: (x, y) has the records of part x as the shorter, those of part y as the longer.
            parts = -(-h // _PART)
            one = parts == 1
            out = [(key[one], row[one], place[one], role[one])]
            own = (rid.to_numpy().view(np.uint64) * np.uint64(_MIX) >> np.uint64(33)).astype(np.int64)
            for as_ in (1, 2):
                cut = np.flatnonzero(~one & (role & as_ > 0))
                each = np.repeat(cut, parts[cut])
                other = np.arange(len(each)) - np.repeat(np.cumsum(parts[cut]) - parts[cut], parts[cut])
                part = own[row[each]] % parts[each]
                x, y = (part, other) if as_ == 1 else (other, part)
                mixed = (x * parts[each] + y + 1).astype(np.uint64) * np.uint64(_MIX)
                out.append((key[each] ^ (mixed >> np.uint64(1)).view(np.int64), row[each], place[each], np.full(len(each), as_)))
            key, row, place, role = (np.concatenate(c) for c in zip(*out))
            pick = pa.array(row)
            # Half a hash is enough for a key: where two lists have one, more is compared and nothing is lost.
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> 32).astype(np.int32)), batch.column(2).take(pick), rid.take(pick), pa.array((4 * place + role).astype(np.int32)), *(pa.array(s[row]) for s in signs)],
                ["key", "m", "rid", "rest", *_SIGNS],
            )

    return run


def _meet(t: float):
    """Pairs of records that meet in a list and pass the filters; the lists come whole, by length."""

    # In thousandths, so that the bounds are whole numbers: place <= n - need is (2000 - e)n - 2000 place >= e m.
    e = int(round(t * 1000))

    def passing(i: np.ndarray, j: np.ndarray, m, rid, place, role, signs) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (shorter, longer) that pass all filters."""
        need = -(-e * (m[i] + m[j]) // 2000)
        ok = (role[i] & 1 > 0) & (role[j] & 2 > 0) & (rid[i] != rid[j]) & (place[i] <= m[i] - need) & (place[j] <= m[j] - need)
        i, j, need = i[ok], j[ok], need[ok]
        differ = np.zeros(len(i), np.int64)
        for s in signs:
            differ += np.bitwise_count(s[i] ^ s[j])
        ok = differ <= m[i] + m[j] - 2 * need
        return rid[i[ok]], rid[j[ok]]

    def few(m, rid, place, role, signs, key) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of many short lists at once: each row against the next one, the next but one ..."""
        at, step = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + step < len(key)]
            # By length: once a partner is too long for the place of the shorter, all later ones are.
            at = at[(key[at] == key[at + step]) & (2000 * place[at] <= (2000 - e) * m[at] - e * m[at + step])]
            yield passing(at, at + step, m, rid, place, role, signs)
            step += 1

    def many(m, rid, place, role, signs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of one long list: blocks of shorter rows against the longer ones in reach."""
        shorter, longer = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        ml, first = m[longer], [s[longer] for s in signs]
        ms = m[shorter]
        # A partner of n words must leave the place of the shorter in its prefix: place <= m - need.
        lo = np.searchsorted(ml, ms, "left")
        hi = np.searchsorted(ml, (2000 * (ms - place[shorter]) - e * ms) // e, "right")
        met = np.flatnonzero(lo < hi)
        met = met[np.lexsort((hi[met], lo[met]))]
        for k in range(0, len(met), _BLOCK):
            block = met[k : k + _BLOCK]
            rows = shorter[block]
            reach = int(hi[block].max())
            for a in range(int(lo[block[0]]), reach, _SPAN):
                b = min(reach, a + _SPAN)
                joint = int(m[rows].max() + ml[b - 1])
                differ = np.bitwise_count(signs[0][rows][:, None] ^ first[0][a:b])
                for s, f in zip(signs[1:], first[1:]):
                    differ += np.bitwise_count(s[rows][:, None] ^ f[a:b])
                p, q = np.divmod(np.flatnonzero(differ <= joint - 2 * -(-e * joint // 2000) + 1), b - a)
                q += a
                i, j = rows[p], longer[q]
                ok = (q >= lo[block[p]]) & (q < hi[block[p]]) & ((m[j] > m[i]) | (rid[j] > rid[i]))
                yield passing(i[ok], j[ok], m, rid, place, role, signs)

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, m, rid, rest = columns[:4]
        signs = [c.view(np.uint64) for c in columns[4:]]
        m, rest = m.astype(np.int64), rest.astype(np.int64)
        place, role = rest >> 2, rest & 3
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        short = np.repeat((size > 1) & (size <= _FEW), size)
        found = list(few(m[short], rid[short], place[short], role[short], [s[short] for s in signs], key[short]))
        for a, n in zip(begin[size > _FEW].tolist(), size[size > _FEW].tolist()):
            cut = slice(a, a + n)
            found += many(m[cut], rid[cut], place[cut], role[cut], [s[cut] for s in signs])
        if found:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # the list that the last batches ended in
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            rest.append(now)
            if rest[0][0][0] == now[0][-1]:
                continue
            now = [np.concatenate(x) for x in zip(*rest)]
            open_ = int(np.searchsorted(now[0], now[0][-1], "left"))
            yield from pairs([c[:open_] for c in now])
            rest = [[c[open_:].copy() for c in now]]
        if rest:
            yield from pairs([np.concatenate(x) for x in zip(*rest)])

    return run


def similar_texts(held: DataFrame, cells: np.ndarray, t: float) -> DataFrame:
    """Pairs (a, b) of rids of different texts of one table with 2c >= t(m + n)."""
    signs = ", ".join(f"{s} long" for s in _SIGNS)
    index = held.select("table_name", "rid", "m", *_SIGNS, "rare", "often").mapInArrow(_postings(t, cells), f"key int, m int, rid long, rest int, {signs}")
    lists = index.repartition("key").sortWithinPartitions("key", "m", "rid")
    pairs = lists.mapInArrow(_meet(t), "a long, b long").distinct()
    whole = held.select("rid", "m", "rare", "often").repartition("rid")  # one exchange for both sides
    left = whole.select(F.col("rid").alias("a"), "m", F.col("rare").alias("x0"), F.col("often").alias("x1"))
    right = whole.select(F.col("rid").alias("b"), F.col("m").alias("n"), F.col("rare").alias("y0"), F.col("often").alias("y1"))
    enough = F.expr(f"2000 * (size(array_intersect(x0, y0)) + size(array_intersect(x1, y1))) >= {int(round(t * 1000))} * (m + n)")
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _texts(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    records = records.select(*(F.col(c).cast("string").alias(c) for c in ("table_name", "id", "text"))).where("id is not null and text is not null")
    held, cells = vectors(records, least)
    held = settle(held, "vectors")
    members = records.select("table_name", "id", *_text_key()).join(held.select("h0", "h1", "rid"), ["h0", "h1"])
    members = members.groupBy("table_name", "id").agg(F.collect_set("rid").alias("rids"))
    return members.select("table_name", "id", F.explode("rids").alias("rid"), (F.size("rids") > 1).alias("several")), held, cells


def near_pairs(records: DataFrame, t: float = 0.8, least: int = 20) -> DataFrame:
    """All pairs of ids of near copies, the smaller id first, copies with equal texts among them."""
    members, held, cells = _texts(records, least)
    members = settle(members, "members").where("table_name is not null and id is not null and rid is not null")
    links = settle(similar_texts(held, cells, t), "links")

    # Both sides of a join have the same columns and filters, so that an exchange of ids serves all joins.
    left = lambda x: x.select(F.col("rid").alias("a"), "table_name", F.col("id").alias("i"))
    right = lambda y: y.select(F.col("rid").alias("b"), F.col("table_name").alias("table"), F.col("id").alias("j"))

    def linked(x: DataFrame, y: DataFrame) -> DataFrame:
        return links.join(left(x), "a").join(right(y), "b").where("table = table_name").select("table_name", "i", "j")

    def equal(x: DataFrame, y: DataFrame) -> DataFrame:
        return left(x).join(right(y), F.expr("a = b")).where("table = table_name").select("table_name", "i", "j")

    # Only ids with several texts can meet more than once; the pairs of all others need no exchange to be distinct.
    once, several = members.where("not several"), members.where("several")
    found = linked(once, once).unionByName(equal(once, once).where("i < j"))
    again = linked(several, members).unionByName(linked(once, several)).unionByName(equal(several, members)).where("i <> j")
    named = lambda c: c.select("table_name", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    return named(found).unionByName(named(again).distinct())


def near_groups(records: DataFrame, t: float = 0.8, least: int = 20) -> DataFrame:
    """Each record of ``least`` words with its group, named by the least id in it, and the number of
    other texts its own is linked with."""
    members, held, cells = _texts(records, least)
    links = settle(similar_texts(held, cells, t), "links")
    grouped = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
    joined = members.join(degree, "rid", "left").join(grouped.withColumnRenamed("node", "rid"), "rid", "left")
    joined = settle(joined.select("table_name", "id", F.coalesce("component", "rid").alias("group"), F.coalesce("links", F.lit(0)).alias("links")), "grouped")
    names = joined.groupBy("group").agg(F.min("id").alias("group_id"))
    return joined.join(names, "group").select("table_name", "id", "group_id", "links")


def texts_of(raw: DataFrame, evidence: DataFrame) -> DataFrame:
    """The records of problem 4: title and snippet of raw_result, statement of evidence."""
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    return (
        raw.select(F.lit("raw_result").alias("table_name"), F.col("raw_id").alias("id"), both.alias("text"))
        .unionByName(evidence.select(F.lit("evidence").alias("table_name"), F.col("evidence_id").alias("id"), F.col("statement").alias("text")))
    )
