"""Piece vocabularies read from a SentencePiece model file, and dynamic programs over them.

Two rules choose among the pieces that an Aho-Corasick automaton finds to end at
a position:

``score`` (unigram models)  the path with the greatest sum of scores; among equal
    sums the longest piece; a character without a piece of its own costs the
    least score minus ten.
``pair`` (BPE models)  the piece whose pair with the piece before it is a fixed
    point of merging.  Every prefix of a text has exactly one such last piece, and
    following these back gives the merge result itself, so a model that is defined
    by merges gets its exact ids from the same left-to-right program.

Only models with the identity normaliser are accepted.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick

BLANK = "▁"
#: Maximal runs that pieces of common vocabularies do not cross; ``Vocabulary`` tests that on its own pieces.
CHUNKS = re.compile(r"▁*[A-Za-z\x7f-\u2580\u2582-\U0010ffff]+|▁*[0-9]+|▁*[\x00-/:-@\[-`{-~]+|▁+")
#: A run of blanks and the word behind it.
WORDS = re.compile(r"▁*[^▁]+|▁+")
UNKNOWN_PENALTY = 10
MANY_CROSSING = 64
#: Length of the beginnings that are remembered, and how many of them.
BEGIN, BEGUN = 8, 50_000
#: Characters given to a window at a time; of a text fed at a time; and of a word beyond which it is fed before it ends.
SLICE, PART, LONG = 64, 65_536, 1024


@dataclass
class Vocabulary:
    """Pieces with ids and scores.  ``bytes_of`` maps byte values to the ids of byte pieces (empty: none)."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: dict[int, int]
    unknown: int
    merges: bool
    pieces: list[bytes] = field(default_factory=list)
    longest: int = 1
    crossing: list[str] | None = None
    crosses: re.Pattern | None = None
    begins: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        crossing = [p for p in self.ids if CHUNKS.findall(p) != [p]]
        self.crossing = crossing if len(crossing) <= MANY_CROSSING else None
        self.crosses = re.compile("|".join(map(re.escape, crossing)) or r"(?!)") if self.crossing is not None else None
        #: Proper beginnings of pieces: a text's end that is none of these can start no piece that later text completes.
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.blank_first = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p in self.ids:
            a.add_word(p, p)
        a.make_automaton()
        return a

    def spell(self, char: str) -> list[int]:
        """Ids of a character that has no piece."""
        if not self.bytes_of:
            return [self.unknown]
        return [self.bytes_of[b] for b in char.encode()]


def load_vocabulary(model: bytes) -> Vocabulary:
    """Vocabulary of a serialized SentencePiece model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
    kinds = pb.ModelProto.SentencePiece
    ids, scores, bytes_of, unknown, pieces = {}, {}, {}, 0, []
    for i, p in enumerate(m.pieces):
        pieces.append(b"")
        if p.type == kinds.BYTE:
            value = int(p.piece[1:-1], 16)
            bytes_of[value] = i
            pieces[i] = bytes([value])
        elif p.type == kinds.UNKNOWN:
            unknown = i
            pieces[i] = " ⁇ ".encode()
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            ids[p.piece] = i
            scores[p.piece] = p.score
            pieces[i] = p.piece.replace(BLANK, " ").encode()
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return Vocabulary(ids, scores, bytes_of, unknown, m.trainer_spec.model_type == 2, pieces)


def in_bits(vocab: Vocabulary) -> Vocabulary:
    """The same pieces read as a unigram model whose scores are minus the bit length of the piece's rank.

    A rule, not training: pieces of a merge vocabulary come in order of merit, and
    the bits of the rank are what a rank code would spend.  Whole numbers keep sums
    exact and make ties frequent, so the tie rule matters.
    """
    scores = {p: -float((k + 1).bit_length()) for k, p in enumerate(sorted(vocab.ids, key=vocab.ids.get))}
    return Vocabulary(vocab.ids, scores, vocab.bytes_of, vocab.unknown, False, vocab.pieces)


class Merges:
    """Merging of strings, and which pairs of pieces it leaves as they are.

    ``merge`` is plain merging: the best-scored pair first, the leftmost of equals.
    ``stable`` answers for a pair by undoing merges at the boundary: the later of the two
    pieces' last merges is taken back, and a merge across the boundary that would have
    come before it spoils the pair.  That needs pieces to rank behind their parts; pairs
    with one that does not (runs of blanks, often) are answered by merging.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 150_000):
        self.scores, self.limit, self.known = vocab.scores, limit, {}
        ranked = sorted(self.scores, key=self.scores.get, reverse=True)
        self.rank = {p: i for i, p in enumerate(ranked) if len(p) > 1}
        #: Piece -> the two parts of its last merge; None for one that merging does not give.
        self.parts: dict[str, tuple[str, str] | None] = {}
        for p in self.rank:
            self._split(p)
        of_score = Counter(self.scores[p] for p in self.rank)
        #: Pieces that do not rank behind their parts or share a score, and those made from such.
        self.odd = {p for p, lr in self.parts.items() if of_score[self.scores[p]] > 1 or (lr and max(self.rank.get(x, -1) for x in lr) >= self.rank[p])}
        while more := {p for p, lr in self.parts.items() if lr and p not in self.odd and not self.odd.isdisjoint(lr)}:
            self.odd |= more

    def _split(self, piece: str) -> None:
        last: list = []
        symbols = self.merge(list(piece), last)
        self.parts[piece] = last[-1] if symbols == [piece] else None

    def merge(self, symbols: list[str], steps: list | None = None) -> list[str]:
        scores = self.scores
        while True:
            best = None
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return symbols
            i = best[1]
            if steps is not None:
                steps.append((symbols[i], symbols[i + 1]))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def stable(self, left: str, right: str) -> bool:
        key = (left, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            got = self.known[key] = self._undone(left, right)
        return got

    def _merged(self, left: str, right: str) -> bool:
        return self.merge(list(left + right)) == ([left, right] if left else [right])

    def _undone(self, left: str, right: str) -> bool:
        rank, parts = self.rank, self.parts
        if parts.get(left, True) is None or parts.get(right, True) is None:
            return False
        if not left:
            return True
        if left in self.odd or right in self.odd:
            return self._merged(left, right)
        whole = left, right
        before = len(rank) + len(self.scores)  # merges across the boundary ranked below this spoil the pair
        while True:
            across = rank.get(left + right)
            if across is not None:
                if left + right in self.odd:
                    return self._merged(*whole)
                if across < before:
                    return False
            one, two = rank.get(left, -1), rank.get(right, -1)
            if one < 0 and two < 0:
                return True
            if one > two:  # the left piece was completed later; of equals the left one is first
                before, left = one, parts[left][1]
            else:  # a merge across stands left of one inside the right piece, so it wins against its equal
                before, right = two + 1, parts[right][0]


class StreamingViterbi:
    """Left-to-right encoder that keeps a window bounded by the longest piece.

    ``push`` takes more of a (normalised) text and, once the window is longer than the
    longest piece, returns the ids that no later text can change: those before the boundary at which the backpointer paths of all
    survivors have met.  Survivors are the positions from which a later piece can
    still start, that is those whose rest of the text is the beginning of a piece,
    and the end.  Matches and scores reach back no further than the longest piece;
    behind that, only the last piece of each position is kept until the paths meet.
    """

    def __init__(self, vocab: Vocabulary, automaton=None, merges: Merges | None = None):
        self.v = vocab
        self.automaton = automaton or vocab.automaton()
        self.m = (merges or Merges(vocab)) if vocab.merges else None
        #: Last pieces by position for the beginnings of texts seen before.
        self.begun: dict[str, list[str]] = {}
        #: Widest window left by a push so far, and number of pushes.
        self.widest = self.pushes = 0
        self.reset()

    def reset(self) -> None:
        self.text = ""  # not yet committed
        #: By position, the piece that ends there on the best path; at 0, the last committed one.
        self.last: list[str] = [""]
        self.score: list[float] = [0.0]
        self.fresh = True

    def push(self, more: str) -> list[int]:
        done = len(self.text)
        self.text += more
        self.pushes += 1
        if self.m is None:
            self._scores(done)
        elif self.fresh:
            self._begin(more)
        else:
            self._pairs(done)
        self.fresh = False
        return self._commit(False) if len(self.text) > self.v.longest else []

    def finish(self) -> list[int]:
        out = self._commit(True) if self.text else []
        self.reset()
        return out

    def stream(self, text: str) -> list[int]:
        """Ids of a whole text, pushed slice by slice."""
        out = self.push(text[:SLICE])
        for i in range(SLICE, len(text), SLICE):
            out += self.push(text[i : i + SLICE])
        return out + self.finish()

    def _begin(self, text: str) -> None:
        """First push of a text.  What a beginning settles is remembered for other texts that share it."""
        begin = text[:BEGIN]
        known = self.begun.get(begin)
        if known is not None:
            self.last = known.copy()
        self._pairs(0)
        if known is None and len(text) > BEGIN:
            if len(self.begun) >= BEGUN:
                self.begun.clear()
            self.begun[begin] = self.last[: BEGIN + 1]

    def _pairs(self, done: int) -> None:
        text, last, known, stable = self.text, self.last, self.m.known.get, self.m.stable
        settled = len(last)
        for end, piece in self.automaton.iter(text, max(0, done - self.v.longest + 1)):
            if settled > end + 1 or end < done:
                continue
            while settled <= end:  # no piece ends there: a character without one
                last.append(text[settled - 1])
                settled += 1
            left = last[end + 1 - len(piece)]
            ok = known((left, piece))
            if ok or (ok is None and stable(left, piece)):
                last.append(piece)
                settled += 1
        last.extend(text[settled - 1 :])

    def _scores(self, done: int) -> None:
        text, last, score, scores, worst = self.text, self.last, self.score, self.v.scores, self.v.worst
        found: list[list[str]] = [[] for _ in range(len(text) - done)]
        for end, piece in self.automaton.iter(text, max(0, done - self.v.longest + 1)):
            if end >= done and len(piece) <= end + 1:
                found[end - done].append(piece)
        for i in range(done, len(text)):
            best, kept, single = None, "", text[i]
            pieces = sorted(found[i - done], key=len, reverse=True)
            for p in pieces:  # longest first, and only a greater sum replaces it
                s = score[i + 1 - len(p)] + scores[p]
                if best is None or s > best:
                    best, kept = s, p
            if single not in pieces:
                s = score[i] + worst
                if best is None or s > best:
                    best, kept = s, single
            score.append(best)
            last.append(kept)

    def _commit(self, final: bool) -> list[int]:
        last, n = self.last, len(self.text)
        if final:
            boundary = n
        else:
            # survivors, walked back until one is left
            text, begins = self.text, self.v.begins
            alive = {n}
            alive.update(i for i in range(max(0, n - self.v.longest + 1), n) if text[i:] in begins)
            while len(alive) > 1:
                top = max(alive)
                alive.discard(top)
                alive.add(top - len(last[top]))
            boundary = alive.pop()
            self.widest = max(self.widest, n - boundary)
        out, at, ids = [], boundary, self.v.ids
        while at:
            piece = last[at]
            got = ids.get(piece)
            if got is not None:
                out.append(got)
            else:
                out += reversed(self.v.spell(piece))
            at -= len(piece)
        out.reverse()
        if boundary and not final:
            self.text, self.last = self.text[boundary:], last[boundary:]
            if not self.m:
                base = self.score[boundary]
                self.score = [s - base for s in self.score[boundary:]]
        return out


def cuts(vocab: Vocabulary, text: str) -> list[str]:
    """Cut a normalised text at boundaries that no piece crosses; every path meets at each of them."""
    if vocab.crosses is None or vocab.crosses.search(text):
        return [text] if text else []
    return CHUNKS.findall(text)


class Remembered(dict):
    """Results by key, worked out when first asked for, in two generations.

    When ``limit`` entries are there they become the old generation and the one before
    is forgotten; what is asked for again moves to the young one, so frequent keys
    stay while memory is bounded by twice the limit.
    """

    def __init__(self, work, limit: int = 150_000):
        super().__init__()
        self.work, self.limit, self.old = work, limit, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
            if len(key) > 256:
                return got
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def parts(vocab: Vocabulary, word: str) -> list[str]:
    """Chunks of a word; one without a leading blank stands behind a single blank."""
    return cuts(vocab, word if word.startswith(BLANK) else BLANK + word)


def slices(text: str):
    """Parts in which a text is fed."""
    return (text[i : i + PART] for i in range(0, len(text), PART))


def streamed(vocab: Vocabulary, parts):
    """Cut a text that comes in parts into words (each with the blanks before it), between which no piece lies.

    Where a word begins all paths have met and the window is empty, so what a word
    yields depends on the word alone and may be remembered.  Yields (words that are
    complete, more of a torn word, whether the torn word ends there).  Only a word
    longer than ``LONG`` is torn, and the whole text where pieces can lie across words.
    """
    tail, torn, first = "", False, True
    for part in parts:
        if not part:
            continue
        text = part.replace(" ", BLANK)
        if first:
            text, first, torn = BLANK + text, False, not vocab.blank_first
        if torn:
            end = text.find(BLANK) if vocab.blank_first else -1
            if end < 0:
                yield (), text, False
                continue
            yield (), text[:end], True
            text, torn = text[end:], False
        text = tail + text
        words = text.split(BLANK)
        if "" in words[1:]:  # several blanks together
            words = WORDS.findall(text)
            tail = words.pop()
        else:
            tail = BLANK + words.pop()
            del words[0]
        yield words, "", False
        if len(tail) > LONG and tail[-1] != BLANK:
            yield (), tail, False
            tail, torn = "", True
    if torn:
        yield (), "", True
    elif tail:
        yield (tail,), "", False
