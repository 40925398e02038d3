"""Token counts without ids: a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches; the dynamic
program carries, for each of the last few positions (a ring as long as the longest
piece), the best score and the number of pieces on the best path, and no
backpointers.  Counts of words, across which no piece lies, add up, so those of
words seen before are looked up.

Two counts are given: ``n_tokens``, what the model's own encoder yields (a merge
vocabulary has the pair rule of ``pieces`` in place of the score), and
``n_unigram`` with ``unigram_score``, count and score of the best path when the
same pieces are read as a unigram model (``pieces.in_bits``, or the model's own
scores if it is one).  Ties go as in the public unigram encoder: the longest last
piece wins.

Defined results: null text counts as empty, with counts and score 0; repeated rows
count alike; an empty table gives an empty result; texts of any length are counted
whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm import pieces
from logtide.llm.common import held
from logtide.llm.sentencepiece_codec import MODEL, read_model

_COUNT_BITS = 40


class Window:
    """Count-only dynamic program: last piece, count and score of the positions that a piece can still start from, in rings."""

    def __init__(self, own: pieces.Vocabulary):
        self.u = pieces.in_bits(own) if own.merges else own
        self.automaton = self.u.automaton()
        self.merges = pieces.Merges(own) if own.merges else None
        self.width = self.u.longest + 1
        #: State after the beginnings of texts seen before.
        self.begun: dict[str, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.at, self.context, self.rings = 0, "", None

    def push(self, text: str) -> None:
        """Go on over more of a text; what came before it is kept as far as a piece can reach back."""
        begin = text[: pieces.BEGIN] if not self.at and len(text) > pieces.BEGIN else None
        known = self.begun.get(begin) if begin else None
        if known is not None:
            self._run(text, pieces.BEGIN, tuple(r.copy() for r in known))
            return
        self.rings = self.rings or tuple([x] * self.width for x in ("", 0, 0.0, 0))
        if begin:
            self._run(begin, 0, self.rings)
            if len(self.begun) >= pieces.BEGUN:
                self.begun.clear()
            self.begun[begin] = tuple(r.copy() for r in self.rings)
            text = text[pieces.BEGIN :]
        self._run(self.context + text, len(self.context), self.rings)

    def _run(self, text: str, done: int, rings: tuple) -> None:
        """Settle the positions of ``text`` behind its first ``done`` characters, which have been."""
        scores, worst, spell, width = self.u.scores, self.u.worst, self.u.spell, self.width
        known, stable = (self.merges.known, self.merges.stable) if self.merges else (None, None)
        last, own, score, count = rings
        base = max(self.at, done) - done  # position of the first character
        i, best, n, single, piece_of, own_n = done, None, 0, False, None, 0
        for end, piece in itertools.chain(self.automaton.iter(text), ((len(text), ""),)):
            if end < done:
                continue
            while i < end:
                here = (base + i) % width
                if not single or piece_of is None:
                    extra = len(spell(text[i]))
                    if not single:
                        s = score[here] + worst
                        if best is None or s > best:
                            best, n = s, count[here] + extra
                    if piece_of is None:
                        piece_of, own_n = text[i], own[here] + extra
                i += 1
                here = (base + i) % width
                last[here], own[here], score[here], count[here] = piece_of, own_n, best, n
                best, single, piece_of = None, False, None
            k = len(piece)
            if not k:
                break
            # pieces that end together come longest first, and only a greater sum replaces
            start = (base + end + 1 - k) % width
            s = score[start] + scores[piece]
            if best is None or s > best:
                best, n = s, count[start] + 1
            if k == 1:
                single = True
            if piece_of is None and known is not None:
                left = last[start]
                ok = known.get((left, piece))
                if ok or (ok is None and stable(left, piece)):
                    piece_of, own_n = piece, own[start] + 1
        self.at, self.rings = base + i, rings
        self.context = text[max(0, len(text) - self.width + 2) :]

    def finish(self) -> tuple[float, int, int]:
        """Score and number of pieces of the best path, and the merge count (0 if the vocabulary is none of merges)."""
        if not self.at:
            return 0.0, 0, 0
        here = self.at % self.width
        out = self.rings[2][here], self.rings[3][here], self.rings[1][here]
        self.reset()
        return out


class Counter:
    """Counts of whole texts.  A part's three figures are packed in one integer, so that adding parts adds all three."""

    def __init__(self, model: bytes):
        self.v = pieces.load_vocabulary(model)
        self.window = Window(self.v)
        # scores of the library's kind may be fractions; whole thousandths are summed
        self.scale = 1 if self.v.merges else 1000
        self.of_chunk = pieces.Remembered(self._chunk, 300_000)
        self.of_word = pieces.Remembered(self._word, 400_000)

    def _finish(self) -> int:
        score, n, own = self.window.finish()
        return (own if self.v.merges else n) | n << _COUNT_BITS | round(-score * self.scale) << 2 * _COUNT_BITS

    def _chunk(self, chunk: str) -> int:
        self.window.push(chunk)
        return self._finish()

    def _word(self, word: str) -> int:
        return sum(map(self.of_chunk.__getitem__, pieces.parts(self.v, word)))

    def count(self, text: str | None) -> tuple[int, int, float]:
        packed = 0
        for words, torn, ended in pieces.streamed(self.v, pieces.slices(text or "")):
            packed += sum(map(self.of_word.__getitem__, words))
            for i in range(0, len(torn), pieces.PART):
                self.window.push(torn[i : i + pieces.PART])
            if ended:
                packed += self._finish()
        mask = (1 << _COUNT_BITS) - 1
        return packed & mask, packed >> _COUNT_BITS & mask, -(packed >> 2 * _COUNT_BITS) / self.scale


def _counter(model: bytes) -> Counter:
    return held(("counts", model), lambda: Counter(model))


def count(docs: DataFrame, model_path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """Counts of every row of ``docs`` (key, text)."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))
    rows = docs.select(docs[key].alias("key"), docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        for batch in batches:
            got = [counter.count(t.as_py()) for t in batch.column(1)]
            own, n, score = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array([s + 0.0 for s in score], pa.float64())],
                ["key", "n_tokens", "n_unigram", "unigram_score"],
            )

    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, n_unigram long, unigram_score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
