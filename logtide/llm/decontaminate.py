"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of lower-cased words.  A text holds an item
when some stretch of it is within ``MAX_EDITS`` (a share of the item's words, so a
similarity of at least 0.8) of the item in word edit distance.

For every window as long as an item:

1. a window with too few (different) word pairs of the items of its length cannot be that near
   (an edit spoils two of an item's pairs at most, or one and pushes one out of the
   window), so it is left out without loss;
2. the rest are embedded by the CGK random walk: at step j the current word is
   copied and the walk moves on by a random bit of (j, word).  Edit distance
   becomes Hamming distance of the copies;
3. bit-sampling LSH compares ``SAMPLED`` steps of the walk with those of the items
   of that length, in ``REPEATS`` independent walks.  Samples are drawn below step n of
   an item of n words: no walk has left its n words there, so every copy is a word and
   none the same by being padding.  At the farthest distance allowed a window agrees
   with its item in two such steps with probability 0.3 to 0.45, so 24 repeats find
   more than 0.95; a window of other text does with less than 0.001, so that about one
   pair in a hundred becomes a candidate (``tests/llm`` measures both);
4. every candidate is verified by exact edit distance around the window.

The benchmark is the query set; it is taken in blocks of up to ``BLOCK`` items and
``BLOCK_CELLS`` (words times different lengths, the size of the largest table), each of
them sent to the executors once, against all rows.

Defined results: null or wordless texts hold nothing, null or wordless items are
held by nothing; an item is reported once per row that holds it, at its nearest
(then first) place; repeated rows are reported alike; empty tables give an empty
result; texts are searched whole; other columns are ignored by ``matches`` and
kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm.common import held

WORD = re.compile(r"[^\W_]+")
MAX_EDITS = 0.2
SAMPLED, REPEATS, SEED = 2, 24, 20_240_101
BLOCK, BLOCK_CELLS = 20_000, 50_000_000
#: Words worked on at a time, and candidate windows embedded at a time.
BATCH_WORDS, BATCH_WINDOWS = 2_000_000, 20_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, with that stretch's start and end (first end, shortest stretch)."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else at.copy()
        for i, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - at) + at
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Matcher:
    """Searches texts for one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        vocabulary: dict[str, int] = {}
        for _, w in split:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary))
        self.vocabulary = vocabulary
        self.other = len(vocabulary)
        self.ids = [i for i, _ in split]
        self.items = [np.array([vocabulary[x] for x in w]) for _, w in split]
        lengths = sorted({len(w) for w in self.items})
        self.lengths = np.array(lengths, np.int64)
        self.edits = {n: int(MAX_EDITS * n) for n in lengths}
        self.of_length = np.zeros((len(lengths), self.other + 1), np.int8)
        for w in self.items:
            self.of_length[lengths.index(len(w)), w] = 1
        if not split:
            return
        pairs = [w[:-1] * (self.other + 1) + w[1:] for w in self.items]
        self.pairs = np.unique(np.concatenate([*pairs, [-1]]))
        self.pairs_of_length = np.zeros((len(lengths), len(self.pairs) + 1), np.int8)
        for w, p in zip(self.items, pairs):
            self.pairs_of_length[lengths.index(len(w)), np.searchsorted(self.pairs, p)] = 1
        # fewest different pairs that a near window of each length has
        self.different = [min(len(np.unique(p)) for w, p in zip(self.items, pairs) if len(w) == n) - 2 * self.edits[n] for n in lengths]
        rng = np.random.default_rng(SEED)
        # bits of (step, word) come from a hash of the word, with a factor and a summand for each repeat and step
        self.hashes = rng.integers(0, 1 << 32, (REPEATS, lengths[-1], 2), dtype=np.uint32) | np.array([1, 0], np.uint32)
        self.sampled = np.stack([np.sort(rng.integers(0, n, (REPEATS, SAMPLED)), axis=1) for n in lengths])
        which = np.array([lengths.index(len(w)) for w in self.items])
        joined = np.concatenate(self.items)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in self.items])[:-1]])
        self.tables = []
        for keys in self._signatures(joined, starts, which):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def _signatures(self, ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
        """For each repeat, the sampled part of the embedding of the windows at ``starts``, as one number each."""
        last = int(self.sampled[np.unique(which)].max()) + 1
        copies = np.empty((last, len(starts)), np.int64)
        rows = np.arange(len(starts))
        for r in range(REPEATS):
            at = starts.copy()
            for j in range(last):
                copies[j] = symbol = ids[np.minimum(at, len(ids) - 1)]  # beyond the window only where nothing is sampled any more
                factor, summand = self.hashes[r, j]
                at += (symbol.astype(np.uint32) * factor + summand) >> np.uint32(31)
            key = which.copy()
            for k in range(SAMPLED):
                key = key * (self.other + 1) + copies[self.sampled[which, r, k], rows]
            yield key

    def candidates(self, ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(window, items) that agree in the sampled steps of some repeat; ``which``: the windows' lengths."""
        for (keys, order), mine in zip(self.tables, self._signatures(ids, starts, which)):
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for w in np.flatnonzero(high > low):
                yield int(w), order[low[w] : high[w]]

    def _windows(self, ids: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of windows with enough word pairs of the items of their length; ``room``: words left in the text."""
        if not len(ids):
            return
        code = ids[:-1] * (self.other + 1) + ids[1:]
        near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        pair = np.where(self.pairs[near] == code, near, len(self.pairs))
        for k, n in enumerate(self.lengths):
            if len(ids) < n:
                continue
            total = np.concatenate([[0], np.cumsum(self.pairs_of_length[k][pair], dtype=np.int32)])
            enough = (total[n - 1 :] - total[: len(total) - n + 1] >= n - 1 - 2 * self.edits[int(n)]) & (room[: len(ids) - n + 1] >= n)
            starts = np.flatnonzero(enough)
            for i in range(0, len(starts), BATCH_WINDOWS):
                some = starts[i : i + BATCH_WINDOWS]
                inside = pair[some[:, None] + np.arange(n - 1)]
                inside = np.sort(np.where(self.pairs_of_length[k][inside] > 0, inside, -1), axis=1)
                new = np.concatenate([inside[:, :1] >= 0, (inside[:, 1:] > inside[:, :-1]) & (inside[:, 1:] >= 0)], axis=1)
                some = some[new.sum(axis=1) >= self.different[k]]
                if len(some):
                    yield some, np.full(len(some), k)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, first word, end word, edits) of every item that a text holds."""
        out: list[tuple[int, int, int, int, int]] = []
        if not self.items:
            return out
        get, other = self.vocabulary.get, self.other
        begin = 0
        while begin < len(texts):
            coded, sizes, end = [], [], begin
            while end < len(texts) and len(coded) < BATCH_WORDS:
                w = words(texts[end])
                coded += [get(x, other) for x in w]
                sizes.append(len(w))
                end += 1
            out += self._find(np.array(coded, np.int64), np.array(sizes, np.int64), begin)
            begin = end
        return out

    def _find(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> list[tuple[int, int, int, int, int]]:
        ends = np.cumsum(sizes)
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        room = ends[row_of] - np.arange(len(ids)) if len(ids) else ids
        found = list(self._windows(ids, room))
        pairs = set()
        if found:
            starts, which = np.concatenate([s for s, _ in found]), np.concatenate([k for _, k in found])
            for i in range(0, len(starts), BATCH_WINDOWS):
                s, k = starts[i : i + BATCH_WINDOWS], which[i : i + BATCH_WINDOWS]
                for w, items in self.candidates(ids, s, k):
                    pairs.update((int(row_of[s[w]]), int(x), int(s[w])) for x in items)
        # texts shorter than an item by no more than the edits allowed have no window; they are verified outright
        for k, n in enumerate(self.lengths):
            slack = self.edits[int(n)]
            short = np.flatnonzero((sizes < n) & (sizes >= n - slack))
            for row in short:
                a = int(ends[row] - sizes[row])
                if self.of_length[k][ids[a : ends[row]]].sum() >= n - slack:
                    pairs.update((int(row), x, a) for x, w in enumerate(self.items) if len(w) == n)
        return self._verified(ids, sizes, ends, pairs, first)

    def _verified(self, ids, sizes, ends, pairs, first) -> list[tuple[int, int, int, int, int]]:
        out, last = [], None
        region: list[int] = []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def settle():
            if last is None:
                return
            row, x = last
            item, a = self.items[x], int(ends[row] - sizes[row])
            low, high = max(a, region[0]), min(int(ends[row]), region[1])
            d, s, e = nearest(item, ids[low:high])
            got = (d, low + s - a, low + e - a)
            if d <= self.edits[len(item)] and (last not in best or got < best[last]):
                best[last] = got

        for row, x, s in sorted(pairs):
            n = len(self.items[x])
            slack = self.edits[n]
            a, b = s - slack, s + n + slack
            if last == (row, x) and a <= region[1]:
                region[1] = max(region[1], b)
                continue
            settle()
            last, region = (row, x), [a, b]
        settle()
        for (row, x), (d, s, e) in sorted(best.items()):
            out.append((first + row, self.ids[x], s, e, d))
        return out


def _matcher(items: tuple) -> Matcher:
    return held(("matcher", items), lambda: Matcher(list(items)))


def _blocks(benchmark: DataFrame) -> Iterator[tuple]:
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    block, total, lengths = [], 0, set()
    for r in rows.toLocalIterator():
        n = len(words(r[1]))
        block.append((r[0], r[1]))
        total += n
        lengths.add(n)
        if len(block) >= BLOCK or total * len(lengths) >= BLOCK_CELLS:
            yield tuple(block)
            block, total, lengths = [], 0, set()
    if block:
        yield tuple(block)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for every row of ``docs`` (key, text) and item of ``benchmark`` (item_id, text) that it holds."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs["text"].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, item_id long, first_word long, end_word long, edits long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            for b in batches:
                got = matcher.find(b.column(1).to_pylist())
                cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], ["key", "item_id", "first_word", "end_word", "edits"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows are filtered where they are read."""
    out = docs
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            for b in batches:
                mask = np.ones(len(b), bool)
                mask[[g[0] for g in matcher.find(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(mask))

        out = out.mapInArrow(run, docs.schema)
    return out
