"""Language-model scoring with a gated recurrent network in numpy.

Tokens are words in lower case (A-Z) and one end mark per document.  Counts of all
training tokens are taken over the whole corpus.  The network's vocabulary is the
most frequent ``VOCABULARY`` of them; any other word is the unknown word times the
word's share of the counts outside the vocabulary, so every probability comes from
one distribution over the words seen plus one slot for a word never seen.

The output softmax is factored: words are put by rank of frequency into classes, the
unknown word into one of its own and frequent words into small ones, and a word's
probability is that of its class times that of the word within its class.  Output biases start at the counts, weights at small fixed
random numbers.  Training is truncated backpropagation in windows of ``WINDOW``
tokens, the state carried from window to window and reset between documents; lanes
are equally long, so that no long document is left to make steps alone.  Each task trains on its own documents from the common weights, and the weights are
averaged by tokens trained on; ``ROUNDS`` times.  The rounds deal the training
documents among them by a hash of the id, so every one makes gradient steps in
exactly one round; counts, vocabulary and all scores take every document as well.
Weights, and with them ``score``, depend on how rows fall into tasks; the other
columns do not.

Scoring carries the state across windows through each whole document.  Documents
are laid end to end in parallel lanes, long ones first.

Words beyond the (at most ``KNOWN``) most frequent, whose number grows with the
corpus, are scored by a join with the counts; only the bounded head is sent to
executors.

Defined results: null text counts as empty (its only token is the end mark); a null
id counts as the empty text for the hash; repeated rows are scored alike; an empty
table gives an empty result, and without training documents every token is
unknown to the base score; texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import table

VOCABULARY = 4096
#: Sizes of classes, and the word numbers up to which they hold.
CLASSES = ((1, 1), (16, 65), (32, 1025), (128, 1 << 31))
KNOWN = 131_072
HIDDEN = 16
WINDOW, LANES = 16, 1024
#: Few tokens are laid in fewer lanes, so that they still make about so many steps.
LEAST_STEPS = 100
SCORE_WINDOW, SCORE_LANES, SCORE_TOKENS = 32, 512, 1_500_000
ROUNDS = 2
RATE = 0.02
HELD_OUT = 10
FLUSH = 400_000
END = b""
_LN10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def class_starts(n: int, sizes=CLASSES) -> np.ndarray:
    """Where the classes of ``n`` words begin, and where the last ends (at ``n`` or, filled up, behind it)."""
    out = [0]
    while out[-1] < n:
        out.append(out[-1] + next(size for size, upto in sizes if out[-1] < upto))
    return np.array(out)


def _exponentials(hidden: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits and their sums by row; where these overflow, of the logits less their greatest."""
    p = hidden @ weights
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    if not np.isfinite(total).all():
        p = hidden @ weights
        p = np.exp(p - p.max(1, keepdims=True))
        total = p.sum(1)
    return p, total


def _sum_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by key, for keys below ``n``."""
    out = np.empty((n, rows.shape[1]), rows.dtype)
    for i, column in enumerate(np.ascontiguousarray(rows.T)):
        out[:, i] = np.bincount(keys, weights=column, minlength=n)
    return out


class Network:
    """Weights, by name, of a network whose words are numbered by falling frequency; word 0 is the unknown word."""

    NAMES = ("embed", "wx", "wh", "bias", "wc", "bc", "wo", "bo")

    def __init__(self, weights: dict[str, np.ndarray], starts: np.ndarray):
        self.w, self.starts = weights, starts
        self.class_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.int16)

    @classmethod
    def fresh(cls, counts: np.ndarray, hidden: int = HIDDEN, sizes=CLASSES) -> Network:
        """Starting weights for words with these counts (of the unknown word first); the last class is filled up with words that never occur."""
        starts = class_starts(len(counts), sizes)
        n = int(starts[-1])
        share = np.full(n, 1e-12)
        share[: len(counts)] = np.maximum(counts, 0) + 0.1
        by_class = np.add.reduceat(share, starts[:-1])
        rng = np.random.default_rng(7)

        def small(*shape):
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        return cls(
            {
                "embed": small(n, hidden),
                "wx": small(hidden, 3 * hidden),
                "wh": small(hidden, 3 * hidden),
                "bias": np.zeros(3 * hidden, np.float32),
                "wc": small(hidden, len(by_class)) * 0.1,
                "bc": np.log(by_class / share.sum()).astype(np.float32),
                "wo": small(n, hidden) * 0.1,
                "bo": np.log(share / np.repeat(by_class, np.diff(starts))).astype(np.float32),
            },
            starts,
        )

    def packed(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.NAMES])

    def unpacked(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in self.NAMES:
            n = self.w[k].size
            out[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return Network(out, self.starts)

    def table(self) -> np.ndarray:
        """What each word as input adds to the gates."""
        return self.w["embed"] @ self.w["wx"] + self.w["bias"]

    def states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False, table: np.ndarray | None = None):
        """Hidden states for a window of inputs (time, lane).  ``fresh``: 1 where a document starts; ``keep``: also what the backward pass needs."""
        n, wh = h.shape[1], self.w["wh"]
        x = (table if table is not None else self.table())[inputs]
        out = np.empty((len(inputs), *h.shape), x.dtype)
        kept = np.empty((5, len(inputs), *h.shape), x.dtype) if keep else None
        for t in range(len(inputs)):
            before = h * (1 - fresh[t])[:, None]
            g = before @ wh
            zr = x[t, :, : 2 * n] + g[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, gn = zr[:, :n], zr[:, n:], g[:, 2 * n :]
            c = r * gn
            c += x[t, :, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                kept[0, t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = before, z, r, c, gn
            before -= c
            before *= z
            before += c
            out[t] = h = before
        return out, h, kept

    def output(self, hidden: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target; adds weight gradients of minus their sum, and returns those of the hidden states."""
        w = self.w
        # biases ride along as weights of a last entry that is always one
        hidden = np.concatenate([hidden, np.ones((len(hidden), 1), hidden.dtype)], 1)
        of_class, of_word = np.concatenate([w["wc"], w["bc"][None]]), np.concatenate([w["wo"], w["bo"][:, None]], 1)
        cls = self.class_of[targets]
        p, total = _exponentials(hidden, of_class)
        rows = np.arange(len(targets))
        logp = np.log(p[rows, cls] / total)
        back = None
        if grads is not None:
            p[rows, cls] -= total
            both = (hidden / total[:, None]).T @ p
            grads["wc"] += both[:-1]
            grads["bc"] += both[-1]
            back = p @ w["wc"].T
            back /= total[:, None]
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(len(self.starts)))
        for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.starts) > 1)):
            at = order[ends[c] : ends[c + 1]]
            mine = slice(self.starts[c], self.starts[c + 1])
            h = hidden[at]
            p, total = _exponentials(h, of_word[mine].T)
            k, i = targets[at] - self.starts[c], rows[: len(at)]
            logp[at] += np.log(p[i, k] / total)
            if grads is not None:
                p[i, k] -= total
                h /= total[:, None]
                both = p.T @ h
                grads["wo"][mine] += both[:, :-1]
                grads["bo"][mine] += both[:, -1]
                back[at] += (p @ w["wo"][mine]) / total[:, None]
        return logp, back

    def gradients(self, inputs, targets, mask, fresh, h) -> tuple[float, dict, np.ndarray]:
        """Minus the log probability of a window's targets where ``mask`` is set, its gradients, and the state after it."""
        w = self.w
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        states, last, kept = self.states(inputs, fresh, h, keep=True)
        on = np.nonzero(mask)
        logp, back = self.output(states[on], targets[on], grads)
        dstates = np.zeros_like(states)
        dstates[on] = back
        n, whole = states.shape[2], w["wh"].T
        before, z, r, c, gn = kept
        # what a change of the state does to the gates, before it is known
        of_c = (1 - z) * (1 - c * c)
        of_z = (before - c) * z * (1 - z)
        of_r = gn * r * (1 - r)
        go = 1 - fresh
        dg = np.empty((*inputs.shape, 3 * n), states.dtype)
        through = np.empty_like(dg)
        dnext = np.zeros_like(last)
        for t in range(len(inputs) - 1, -1, -1):
            dh = dstates[t] + dnext
            dc = np.multiply(dh, of_c[t], out=dg[t, :, 2 * n :])
            np.multiply(dh, of_z[t], out=dg[t, :, :n])
            np.multiply(dc, of_r[t], out=dg[t, :, n : 2 * n])
            through[t, :, : 2 * n] = dg[t, :, : 2 * n]
            np.multiply(dc, r[t], out=through[t, :, 2 * n :])
            dh *= z[t]
            dh += through[t] @ whole
            dh *= go[t][:, None]
            dnext = dh
        grads["wh"] += before.reshape(-1, n).T @ through.reshape(-1, 3 * n)
        flat, words = dg.reshape(-1, 3 * n), inputs.ravel()
        grads["wx"] += w["embed"][words].T @ flat
        grads["bias"] += flat.sum(0)
        grads["embed"] += _sum_by(words, flat @ w["wx"].T, len(w["embed"]))
        return -float(logp.sum()), grads, last


def lanes(docs: list[np.ndarray], width: int):
    """Documents end to end in at most ``width`` lanes: the lanes' lengths, falling, and all lanes end to end as
    arrays of document numbers in order; nothing is as large as the longest lane times their number."""
    heap = [(0, i) for i in range(min(width, len(docs)))]
    mine: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, i = heapq.heappop(heap)
        mine[i].append(d)
        heapq.heappush(heap, (n + len(docs[d]), i))
    sizes = [sum(len(docs[d]) for d in ds) for ds in mine]
    order = sorted(range(len(mine)), key=lambda i: -sizes[i])
    return np.array([sizes[i] for i in order], np.int64), [d for i in order for d in mine[i]]


def stream(net: Network, docs: list[np.ndarray], end: int, width: int, window: int):
    """Documents end to end, cut into lanes of equal length: (time, lane) arrays of inputs, targets, mask and starts, and the lanes' first states.

    Equal lanes keep every step full, so a long document does not go on alone with
    steps of its own.  Where a cut falls inside a document, the lane begins with the
    state that ``net`` has after all of the document before it.
    """
    flat = np.concatenate(docs)
    starts = np.cumsum([0, *map(len, docs[:-1])])
    length = max(-(-len(flat) // width), window)
    n = -(-len(flat) // length)

    def laid(x, kind):
        out = np.zeros(n * length, kind)
        out[: len(flat)] = x
        return np.ascontiguousarray(out.reshape(n, length).T)

    first = np.zeros(len(flat), np.float32)
    first[starts] = 1
    before = np.roll(flat, 1)
    before[starts] = end
    h = np.zeros((n, net.w["wh"].shape[0]), np.float32)
    cuts = np.arange(1, n) * length
    owner = starts[np.searchsorted(starts, cuts, side="right") - 1]
    # (first, length) of what has to be read before each cut, long ones first; a document cut more than once is read to each cut
    lead = sorted(((int(c - o), int(o), i) for i, (c, o) in enumerate(zip(cuts, owner), 1) if c > o), reverse=True)
    table_ = net.table()
    at, nothing = np.zeros((len(lead), h.shape[1]), np.float32), np.zeros((1, len(lead)), np.float32)
    lengths, firsts = np.array([k for k, _, _ in lead]), np.array([o for _, o, _ in lead])
    live = len(lead)
    for t in range(lead[0][0] if lead else 0):
        while lengths[live - 1] <= t:
            live -= 1
        now = before[firsts[:live] + t][None]
        _, at[:live], _ = net.states(now, nothing[:, :live], at[:live], table=table_)
    for x, (_, _, i) in zip(at, lead):
        h[i] = x
    return laid(before, np.int32), laid(flat, np.int32), laid(1, bool), laid(first, np.float32), h


def train(net: Network, docs: list[np.ndarray], end: int, rate: float = RATE, window: int = WINDOW, width: int = LANES) -> tuple[Network, int]:
    """One pass of truncated backpropagation over ``docs`` (arrays of word numbers); also the number of tokens."""
    width = min(width, max(sum(map(len, docs)) // (window * LEAST_STEPS), 1))
    inputs, targets, used, fresh, h = stream(net, docs, end, width, window)
    net = net.unpacked(net.packed())
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step, t in enumerate(range(0, len(targets), window), 1):
        part = slice(t, t + window)
        mask = used[part]
        live = int(mask[0].sum())  # only the last lane may be shorter
        cut = (part, slice(0, live))
        h = h[:live]
        _, grads, h = net.gradients(inputs[cut], targets[cut], mask[:, :live], fresh[cut], h)
        n = max(int(mask.sum()), 1)
        for k, g in grads.items():
            g /= n
            first[k] += 0.1 * (g - first[k])
            g *= g
            second[k] += 0.01 * (g - second[k])
            g = np.sqrt(second[k] / (1 - 0.99**step))
            g += 1e-6
            net.w[k] -= (rate / (1 - 0.9**step)) * first[k] / g
    return net, int(used.sum())


def log_probabilities(net: Network, docs: list[np.ndarray], end: int, width: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log probability of every document, the state carried through all of it."""
    out = np.zeros(len(docs))
    sizes, order = lanes(docs, width)
    if not order:
        return out
    targets = np.concatenate([docs[d] for d in order]).astype(np.int32)
    lengths = np.array([len(docs[d]) for d in order])
    rows = np.repeat(np.array(order, np.int32), lengths)
    starts = np.cumsum(lengths) - lengths
    inputs = np.roll(targets, 1)
    inputs[starts] = end
    first = np.zeros(len(targets), np.float32)
    first[starts] = 1
    offsets = np.cumsum(sizes) - sizes
    table_ = net.table()
    h = np.zeros((len(sizes), net.w["wh"].shape[0]), np.float32)
    for t in range(0, int(sizes[0]), window):
        live = int((sizes > t).sum())
        steps = np.arange(t, min(t + window, int(sizes[0])))[:, None]
        on = steps < sizes[None, :live]
        at = np.where(on, offsets[None, :live] + steps, 0)
        states, h, _ = net.states(inputs[at], first[at], h[:live], table=table_)
        at = at[on]
        logp, _ = net.output(states[on], targets[at])
        out += np.bincount(rows[at], weights=logp, minlength=len(docs))
    return out


class Words:
    """The frequent words: their counts, and numbers in the network (0: outside its vocabulary)."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, vocabulary: int = VOCABULARY):
        self.of = {w: i for i, (w, _) in enumerate(top)}
        counts = np.array([c for _, c in top], np.float64)
        self.n, self.v = total, distinct
        inside = min(vocabulary - 1, len(top))
        self.number = np.zeros(len(top) + 1, np.int32)
        self.number[:inside] = np.arange(1, inside + 1)
        #: The network's own words alone: a small table, for steps that need no other.
        self.inside = {w: i for i, (w, _) in enumerate(top[:inside], 1)}
        rest = total - counts[:inside].sum()
        self.network_counts = np.concatenate([[rest], counts[:inside]])
        #: Denominators of the base score and of a word's share outside the vocabulary.
        self.base_sum = total + 0.1 * (distinct + 1)
        self.rest_sum = rest + 0.1 * (distinct - inside + 1)
        self.base = np.append(np.log10((counts + 0.1) / self.base_sum), 0.0)
        self.share = np.append(np.log10((counts + 0.1) / self.rest_sum), 0.0)
        self.share[:inside] = 0.0
        self.end = int(self.number[self.of[END]]) if END in self.of else 0

    def numbers(self, ts: list[bytes]) -> np.ndarray:
        """Numbers of tokens in the network."""
        return np.fromiter(map(self.inside.get, ts, repeat(0)), np.int32, len(ts))

    def looked_up(self, ts: list[bytes]) -> np.ndarray:
        """Places of tokens among the frequent ones; their number for any other."""
        at = self.numbers(ts).astype(np.int64) - 1  # the network's words are the first of the frequent ones
        rest = np.flatnonzero(at < 0)
        at[rest] = np.fromiter(map(self.of.get, map(ts.__getitem__, rest.tolist()), repeat(len(self.of))), np.int64, len(rest))
        return at


def counts_of(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) >= FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """The most frequent tokens, at most ``most`` of them, by falling count.

    Whole bins of counts (octaves cut in eight) are taken from the top while they fit, then
    whole counts of the next bin, then tokens of the next count by a hash, a few short of
    the room.  So what reaches the driver is bounded however many tasks hold counts.
    """
    room = KNOWN if most is None else most
    bin_ = F.floor(F.log2("c") * 8)
    wanted = F.lit(False)
    for level, of in ((bin_, F.lit(True)), (F.col("c"), None)):
        of = of if of is not None else bin_ == next_
        sizes = counts.where(of).groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
        next_ = least = None
        for r in sizes:
            if r["n"] > room:
                next_, of_next = r["b"], r["n"]
                break
            least, room = r["b"], room - r["n"]
        if least is not None:
            wanted = wanted | (of & (level >= least))
        if next_ is None:
            break
    else:
        part = 1 << 20
        wanted = wanted | ((F.col("c") == next_) & (F.pmod(F.xxhash64("token"), F.lit(part)) < int(part * 0.98 * room / of_next)))
    found = counts.where(wanted).select("token", "c").toArrow()
    return sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))


def _train_round(net: Network, words, texts: DataFrame) -> Network:
    """One round over ``texts``; ``words`` is a broadcast."""
    sent = texts.sparkSession.sparkContext.broadcast(net)
    n = len(net.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, w = sent.value, words.value
        now, done, docs, size = start, 0, [], 0
        for b in batches:
            for t in b.column(0):
                docs.append(w.numbers(tokens(t.as_py())))
                size += len(docs[-1])
                if size >= SCORE_TOKENS:
                    now, k = train(now, docs, w.end)
                    done, docs, size = done + k, [], 0
        if docs:
            now, k = train(now, docs, w.end)
            done += k
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([(now.packed() * np.float32(done)).tobytes()], pa.binary()), pa.array([done], pa.int64())], ["sums", "n"])

    def add(pdf):
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["sums"]).astype(np.float32)
        return pdf.iloc[:1][["salt"]].assign(sums=[total.tobytes()], n=[int(pdf["n"].sum())])

    rows = texts.mapInArrow(run, "sums binary, n long").withColumn("salt", F.spark_partition_id() % 32)
    # summed in two levels, so that no task and not the driver holds more than a few dozen networks at once
    once = rows.groupBy("salt").applyInPandas(add, "salt int, sums binary, n long")
    total, done = np.zeros(n), 0
    for r in once.collect():
        total += np.frombuffer(r["sums"], np.float32)
        done += r["n"]
    sent.destroy()
    return net.unpacked(total / done) if done else net


def fit(docs: DataFrame, key: str = "doc_id"):
    """Network, frequent words (themselves, and as a broadcast) and counts from ``docs`` (key, text), the held-out tenth left aside."""
    crc = _crc(docs, key)
    training = docs.where(crc % HELD_OUT != 0)
    counts = table(counts_of(training.select("text")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = Words(frequent(counts), total["n"] or 0, total["v"])
    sent = docs.sparkSession.sparkContext.broadcast(words)
    net = Network.fresh(words.network_counts)
    for k in range(ROUNDS):
        share = F.floor(crc / HELD_OUT) % ROUNDS == k
        net = _train_round(net, sent, training.where(share).select("text"))
    return net, words, sent, counts


def _crc(docs: DataFrame, key: str):
    return F.crc32(F.coalesce(docs[key].cast("string"), F.lit("")))


def score(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base score and network's log10 probability of every row of ``docs`` (key, text)."""
    net, words, sent_words, counts = fit(docs, key)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(docs[key].alias("key"), docs["text"], (_crc(docs, key) % HELD_OUT == 0).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, row long, n_tokens long, n_head long, base double, score double, rest array<struct<token:binary,m:int>>"
    rest_type = pa.list_(pa.struct([("token", pa.binary()), ("m", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, w = sent.value, sent_words.value
        other = len(w.of)

        def scored(keys, held, ids, docs, head, base, extra, rest):
            logp = log_probabilities(net, docs, w.end) / _LN10 + np.array(extra)
            n = [len(d) for d in docs]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array(held, pa.bool_()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(base, pa.float64()), pa.array(logp, pa.float64()), pa.array(rest, rest_type)],
                ["key", "held_out", "row", "n_tokens", "n_head", "base", "score", "rest"],
            )

        now: tuple = ([], [], [], [], [], [], [], [])
        size = 0
        for b in batches:
            for i in range(len(b)):
                ts = tokens(b.column(1)[i].as_py())
                at = w.looked_up(ts)
                outside = at == other
                now[0].append(b.column(0).slice(i, 1))
                now[1].append(b.column(2)[i].as_py())
                now[2].append(b.column(3)[i].as_py())
                now[3].append(w.number[at])
                now[4].append(int(len(at) - outside.sum()))
                now[5].append(float(w.base[at].sum()))
                now[6].append(float(w.share[at].sum()))
                rest = Counter(map(ts.__getitem__, np.flatnonzero(outside).tolist()))
                now[7].append([{"token": x, "m": m} for x, m in rest.items()])
                size += len(at)
                if size >= SCORE_TOKENS:
                    yield scored(*now)
                    now, size = ([], [], [], [], [], [], [], []), 0
        if now[0]:
            yield scored(*now)

    done = rows.mapInArrow(run, schema)
    # the row itself goes along under a key that is no word (it has a blank) and spreads evenly
    own = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary").alias("token"), F.lit(0).alias("m"))
    parts = done.withColumn("part", F.explode(F.concat(F.array(own), "rest")))
    own_row = F.col("part.m") == 0
    wide = ["key", "held_out", "n_tokens", "n_head", "base", "score"]
    parts = parts.select("row", F.col("part.token").alias("token"), F.col("part.m").alias("m"), *(F.when(own_row, F.col(c)).alias(c) for c in wide))
    joined = parts.join(counts, "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = F.sum(F.when(F.col("m") > 0, F.col("m") * F.log10((c + 0.1) / words.rest_sum)))
    base = F.sum(F.when(F.col("m") > 0, F.col("m") * F.log10((c + 0.1) / words.base_sum)))
    known = F.sum(F.when((F.col("m") > 0) & (c > 0), F.col("m")))
    out = joined.groupBy("row").agg(*(F.first(x, ignorenulls=True).alias(x) for x in wide), rest.alias("rest_score"), base.alias("rest_base"), known.alias("rest_known"))
    zero = F.lit(0.0)
    return out.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", zero)).alias("score"),
    )
