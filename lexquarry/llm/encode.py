"""Problem 7: token ids of the whole corpus by a byte-level BPE vocabulary.

1. ``count_words`` counts the pre-tokens ("words") of all documents.
2. ``Lexicon.build`` encodes the most frequent ones by exact merging and compiles them into a
   minimal acyclic automaton: equal suffixes share states, and every edge carries the number of
   words that sort before it, so that a walk through the automaton adds up to the word's place in
   the table of id lists. The tables are ``.npy`` files in the shared folder, memory-mapped by
   all workers of a machine.
3. ``encode`` walks all words of an Arrow batch through the automaton in lockstep, byte by byte,
   and merges words that the lexicon does not hold exactly, once each.

The lexicon decides only the speed: ids are the same whatever it holds.

Defined results. Null and empty texts give an empty list; blank texts are encoded as they are.
Strings of special tokens are ordinary text. Long texts are encoded whole (a batch is worked off in
slices of whole documents of about ``SLICE_BYTES``). Repeated rows give repeated rows. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import io
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.frequent import most_frequent
from lexquarry.session import scratch_path

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 32_768
LONGEST_WORD = 32
SLICE_BYTES = 4 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def split_words(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token of UTF-8 ``data`` starts.

    The rule: an apostrophe with s, t, re, ve, m, ll or d; else a run of letters, of numbers or of
    other marks, each with one blank before it; else white space, which leaves its last character
    to a following word. No word crosses the start of a document.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = _classes()
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (padded[lead + i] for i in range(4))
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        point = np.where(
            size == 2,
            (b0 & 0x1F) << 6 | (b1 & 0x3F),
            np.where(
                size == 3,
                (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | (b2 & 0x3F),
                (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | (b3 & 0x3F),
            ),
        )
        of = table[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            part = size > i
            kind[lead[part] + i] = of[part]
    is_doc = np.zeros(n + 4, bool)
    is_doc[doc_starts[doc_starts < n]] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= is_doc[: n + 1]
    # White space before something else: its last character stands alone or, if a blank, joins it.
    turn = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~is_doc[1:n]) + 1
    if len(turn):
        last = turn - 1
        for _ in range(2):
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        start[last] = True
        start[turn[data[last] == 0x20]] = False
    # Contractions.
    mark = np.flatnonzero((data == 0x27) & start[:n])
    if len(mark):
        mark = mark[~is_doc[mark + 1]]
        tail = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = tail[mark + 1], tail[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~is_doc[mark + 2]
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return np.flatnonzero(start[:n])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of slices of whole rows."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    rows = len(texts)
    if not rows:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        # What lies behind a null is not text: null rows get length 0.
        valid = np.asarray(texts.is_valid())
        if ((offsets[1:] - offsets[:-1])[~valid] > 0).any():
            filled = texts.fill_null("")
            yield from _slices(pa.RecordBatch.from_arrays([filled], ["text"]), 0)
            return
    first = 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = np.uint64(0x100000001B3)
    for batch in batches:
        for _, _, data, offsets in _slices(batch, 0):
            starts = split_words(data, offsets)
            lengths = np.diff(np.append(starts, len(data)))
            usable = lengths <= LONGEST_WORD
            starts, lengths = starts[usable], lengths[usable]
            key = lengths.astype(np.uint64) + np.uint64(0xCBF29CE484222325)
            live = np.arange(len(starts))
            with np.errstate(over="ignore"):
                for j in range(LONGEST_WORD):
                    live = live[lengths[live] > j]
                    if not len(live):
                        break
                    k = (key[live] ^ data[starts[live] + j]) * step
                    key[live] = k ^ (k >> np.uint64(29))
            _, where, count = np.unique(key, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a : a + m] for a, m in zip(starts[where].tolist(), lengths[where].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(count, pa.int64())], ["word", "n"])


def count_words(documents: DataFrame) -> DataFrame:
    """How often each word of up to ``LONGEST_WORD`` bytes occurs in all documents."""
    parts = documents.select("text").where("text is not null").mapInArrow(_word_counts, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Merger:
    """Exact merging of one word by the ranks of a vocabulary."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self._core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._held: dict[bytes, list[int]] = {}

    def __call__(self, word: bytes) -> list[int]:
        ids = self._held.get(word)
        if ids is None:
            if len(self._held) >= 200_000:
                self._held.clear()  # bounds the memory of a long task
            ids = self._held[word] = self._core.encode_single_piece(word)
        return ids


class Lexicon:
    """A minimal acyclic automaton over words, with a list of ids for each."""

    def __init__(self, byte_class: np.ndarray, edges: np.ndarray, final: np.ndarray, ids_at: np.ndarray, ids: np.ndarray):
        self.byte_class, self.edges, self.final, self.ids_at, self.ids = byte_class, edges, final, ids_at, ids

    PARTS = ("byte_class", "edges", "final", "ids_at", "ids")

    @classmethod
    def build(cls, words: list[bytes], merge: Merger) -> Lexicon:
        words = sorted(set(words))
        children: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (parent, byte) of the states not yet shared

        def share(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte = path.pop()
                child = children[parent][byte]
                key = (final[child], tuple(children[child].items()))
                children[parent][byte] = register.setdefault(key, child)

        before = b""
        for word in words:
            common = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                common += 1
            share(common)
            state = children[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                children.append({})
                final.append(False)
                children[state][byte] = len(children) - 1
                path.append((state, byte))
                state = len(children) - 1
            final[state] = True
            before = word
        share(0)
        # Renumber the reachable states; state 0 becomes the dead state, 1 the root.
        number, order, stack = {0: 1}, [0], [0]
        while stack:
            for child in children[stack.pop()].values():
                if child not in number:
                    number[child] = len(order) + 1
                    order.append(child)
                    stack.append(child)
        below: dict[int, int] = {}

        def count(state: int) -> int:
            todo = [state]
            while todo:
                s = todo[-1]
                open_ = [c for c in children[s].values() if c not in below]
                if open_:
                    todo.extend(open_)
                else:
                    below[s] = final[s] + sum(below[c] for c in children[s].values())
                    todo.pop()
            return below[state]

        count(0)
        used = sorted({b for s in order for b in children[s]})
        byte_class = np.zeros(256, np.int64)
        byte_class[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        edges = np.zeros(((len(order) + 1), width), np.int64)  # target << 32 | words that sort before
        is_final = np.zeros(len(order) + 1, bool)
        for s in order:
            skipped = int(final[s])
            is_final[number[s]] = final[s]
            for byte, child in sorted(children[s].items()):
                edges[number[s], byte_class[byte]] = number[child] << 32 | skipped
                skipped += below[child]
        lists = [merge(w) for w in words]
        ids_at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = np.array([i for x in lists for i in x], np.int32)
        return cls(byte_class, edges, is_final, ids_at, flat)

    def places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place of each word in the table of id lists; -1 where the lexicon lacks it."""
        flat, width = self.edges.reshape(-1), self.edges.shape[1]
        symbols = self.byte_class[data]
        place = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(lengths <= LONGEST_WORD)
        state, sum_, at, left = np.ones(len(live), np.int64), np.zeros(len(live), np.int64), starts[live], lengths[live]
        while len(live):
            edge = flat[state * width + symbols[at]]
            state = edge >> 32
            sum_ += edge & 0xFFFFFFFF
            at = at + 1
            left = left - 1
            done = (left == 0) & self.final[state]
            place[live[done]] = sum_[done]
            on = (left > 0) & (state > 0)
            live, state, sum_, at, left = live[on], state[on], sum_[on], at[on], left[on]
        return place

    def save(self, spark: SparkSession) -> str:
        """Write the tables into the shared folder; each executor fetches them once, to map them (``load``)."""
        path = scratch_path(spark, "lexicon")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in self.PARTS:
            np.save(out := io.BytesIO(), getattr(self, part))
            name = f"{path.rsplit('/', 1)[-1]}-{part}.npy"
            stream = files.create(jvm.org.apache.hadoop.fs.Path(folder, name))
            stream.write(bytearray(out.getvalue()))
            stream.close()
            spark.sparkContext.addFile(f"{path}/{name}")
        return path.rsplit("/", 1)[-1]

    @classmethod
    def load(cls, name: str) -> Lexicon:
        return cls(*(np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r") for part in cls.PARTS))


def encode_slice(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, merge: Merger) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice of documents, and where each document's ids start."""
    starts = split_words(data, offsets)
    lengths = np.diff(np.append(starts, len(data)))
    place = lexicon.places(data, starts, lengths)
    known = place >= 0
    held = np.where(known, place, 0)
    size = np.where(known, lexicon.ids_at[held + 1] - lexicon.ids_at[held], 0) if len(lexicon.ids) else np.zeros(len(starts), np.int64)
    raw = data.tobytes()
    unseen = np.flatnonzero(~known)
    lists = [merge(raw[a : a + m]) for a, m in zip(starts[unseen].tolist(), lengths[unseen].tolist())]
    size[unseen] = [len(x) for x in lists]
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.zeros(at[-1], np.int32)
    if len(lexicon.ids):
        k = np.flatnonzero(known)
        longest = int(size[k].max()) if len(k) else 0
        first, begin, many = at[k], lexicon.ids_at[place[k]], size[k]
        for j in range(longest):
            ids[first + j] = lexicon.ids[begin + j]
            more = many > j + 1
            first, begin, many = first[more], begin[more], many[more]
    if lists:
        many = size[unseen]
        total = np.cumsum(many)
        inside = np.arange(total[-1]) - np.repeat(total - many, many)
        ids[np.repeat(at[unseen], many) + inside] = np.fromiter((i for x in lists for i in x), np.int32, count=int(total[-1]))
    return ids, at[np.searchsorted(starts, offsets)]


def encode(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id`` and ``ids`` of every document; ``vocabulary`` is a file of base64 tokens and ranks."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # a published vocabulary: about a megabyte
    frequent = most_frequent(count_words(documents), lexicon_words)
    lexicon = Lexicon.build([bytes(r.word) for r in frequent], Merger(ranks))
    saved = spark.sparkContext.broadcast((lexicon.save(spark), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, ranks = saved.value
        held, merge = Lexicon.load(where), Merger(ranks)
        for batch in batches:
            for first, end, data, offsets in _slices(batch, 1):
                ids, at = encode_slice(data, offsets, held, merge)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")
