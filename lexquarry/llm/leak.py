"""Problem 8: evaluation texts in the corpus.

A word is a maximal run of letters or digits, lower-cased. ``ngram_set`` turns the evaluation
items into a sorted array of 64-bit hashes of their 12-word windows; ``leaked`` streams the
documents past it in Arrow batches, looks up every window and confirms each hit word for word.

Defined results. Null, empty or blank texts and items of fewer than ``n`` words leak nothing.
Repeated items each count. Repeated documents each count. Empty tables give no rows. Texts are
read whole whatever their length; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexquarry.session import settle

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: The held-out set must fit into every worker; beyond this it is split into several passes.
MAX_WINDOWS = 2_000_000


def words(text: str) -> list[str]:
    if "İ" in text:  # the one letter whose lower case holds a mark that is no letter
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all windows of ``n`` word ids."""
    m = len(ids) - n + 1
    h = np.zeros(max(m, 0), dtype=np.uint64)
    if m > 0:
        with np.errstate(over="ignore"):
            for i in range(n):
                h = h * _BASE + ids[i : i + m]
    return h


class NgramSet:
    """The windows of some items: sorted hashes, and the items and words behind each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        keys, owner, place = [], [], []
        self.item_ids = []
        for item_id, text in items:
            if item_id is None or not text:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.uint64)
            if len(ids) < n:
                continue
            h = window_hashes(ids, n)
            keys.append(h)
            owner.append(np.full(len(h), len(self.texts)))
            place.append(np.arange(len(h)))
            self.texts.append(ids)
            self.item_ids.append(item_id)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)

    def _hits(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The word ids of a text, and each window whose hash is held, with the range of its entries."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words(text)), dtype=np.uint64)
        n = self.n
        if len(ids) < n or not len(self.keys):
            return ids, []
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        full = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of nothing but known words
        if not len(full):
            return ids, []
        h = window_hashes(ids, n)[full]
        lo = np.searchsorted(self.keys, h, "left")
        hi = np.searchsorted(self.keys, h, "right")
        return ids, list(zip(full[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()))

    def _same(self, ids: np.ndarray, at: int, k: int) -> bool:
        own, where = self.owner[k], self.place[k]
        return np.array_equal(ids[at : at + self.n], self.texts[own][where : where + self.n])

    def items_in(self, text: str) -> set[int]:
        ids, hits = self._hits(text)
        found = set()
        for at, a, b in hits:
            for k in range(a, b):
                item = self.item_ids[self.owner[k]]
                if item not in found and self._same(ids, at, k):
                    found.add(item)
        return found

    def windows_in(self, text: str) -> list[int]:
        """The numbers of the words at which windows of the items begin, confirmed word for word."""
        ids, hits = self._hits(text)
        return [at for at, a, b in hits if any(self._same(ids, at, k) for k in range(a, b))]


def _groups(items: DataFrame, max_windows: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in groups of at most ``max_windows`` words, or of one item, one at a time, and whether more follow."""
    now: list[tuple[int, str]] = []
    room = max_windows
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        size = len(row.text) // 2 + 1
        if now and size > room:
            yield now, True
            now, room = [], max_windows
        now.append((row.item_id, row.text))
        room -= size
    yield now, False


def leaked(documents: DataFrame, items: DataFrame, n: int = 12, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Each (doc_id, item_id) that shares at least ``n`` consecutive words.

    The evaluation set is the small side and is sent to all workers. Its size is checked: items
    are taken in groups of at most ``max_windows`` words, one pass over the corpus for each group,
    so a larger set costs more passes and not more memory.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    out = None
    for group, more in _groups(items, max_windows):
        shared = spark.sparkContext.broadcast(NgramSet(group, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                docs, hits = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        for item in held.items_in(text):
                            docs.append(doc_id)
                            hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        part = documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, schema)
        if more:  # a pass is done, and its group gone, before the next one is read
            part = settle(part.distinct(), "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def cut_windows(text: str, windows: list[int], n: int) -> str:
    """``text`` without the words of the windows of ``n`` words that begin at these words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    bad = np.zeros(len(spans), bool)
    for at in windows:
        bad[at : at + n] = True
    kept, last = [], 0
    for i, (a, b) in enumerate(spans):
        if bad[i]:
            if not i or not bad[i - 1]:
                kept.append(text[last:a])
            last = b
    return "".join([*kept, text[last:]])


def remove_spans(text: str | None, held: NgramSet) -> str | None:
    """``text`` without the stretches of words that stand in the held-out set."""
    return cut_windows(text, held.windows_in(text), held.n) if text else text


def cleaned(documents: DataFrame, items: DataFrame, n: int = 12, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All documents: doc_id and text without each stretch of at least ``n`` words of an item; null stays null.

    Items are taken in groups as in ``leaked``. Each pass notes its windows, and all are cut out at the end,
    so that no words become neighbours that were none.
    """
    spark = documents.sparkSession
    schema = "doc_id long, text string, windows array<int>"
    rows = documents.selectExpr("doc_id", "text", "cast(array() as array<int>) as windows")
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32())]
    for group, more in _groups(items, max_windows):
        shared = spark.sparkContext.broadcast(NgramSet(group, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                docs, texts, windows = (batch.column(i).to_pylist() for i in range(3))
                noted = [[*w, *held.windows_in(t)] if t else w for t, w in zip(texts, windows)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((docs, texts, noted), kinds)], ["doc_id", "text", "windows"])

        rows = rows.mapInArrow(scan, schema)
        if more:
            rows = settle(rows, "noted")
            shared.destroy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, windows = (batch.column(i).to_pylist() for i in range(3))
            texts = [cut_windows(t, w, n) if w else t for t, w in zip(texts, windows)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, kinds[0]), pa.array(texts, kinds[1])], ["doc_id", "text"])

    return rows.mapInArrow(cut, "doc_id long, text string")
