"""Quality rules: minimum-covariance-determinant outlier rejection per language and source.

Every document becomes a vector of transformed statistics: logarithms of mean word
length, of punctuation and symbols per word, of lines per word, and of the share of
different words.  All four vary in ordinary text, so none of them is degenerate, and
each is smoothed by ``PRIOR_WORDS`` words of ordinary text so that short documents do
not look extreme.  Within each (lang, source) group:

1. concentration steps (keep the half with the smallest Mahalanobis distance,
   re-estimate, repeat) run from two deterministic starts, and the one with the
   smaller determinant wins;
2. the scatter of the half is made consistent: it is scaled so that the group's
   median distance is that of a normal sample;
3. one reweighting step takes the rows within the 0.975 quantile and estimates
   centre and scatter from all of them;
4. rows beyond ``CUTOFF`` are rejected.

Only per-group, per-distance-bin moments are shuffled, so a hot group costs no more
than any other.

A group's scatter is shrunk toward the scatter pooled within all groups, with the
weight of ``POOL_ROWS`` rows against its own, and the pooled one in the same way
toward a fixed diagonal.  Both fade as rows come in: a group of thousands goes by
its own scatter, one of a few rows by that of all groups, and groups of any size, one
row included, are well defined.  ``own_share`` of ``fit`` reports the least share of
its own scatter in a group's variances.

Defined results: null text counts as empty (no words, so the base rules fail);
null ``lang`` or ``source`` form groups of their own; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored by
``judge`` and passed through by ``keep``.

All of it is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.binding import bind, let
from logtide.llm.common import SPACE_CLASS, SPACES, table, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
GRAM = 5
SYMBOLS = "#*$%&|<>"

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Names of the transformed statistics, and what is taken for their variances before any row is seen.
DIMS = ("x0", "x1", "x2", "x3")
TARGET = (0.001, 0.02, 0.1, 0.01)
#: Words of ordinary text that every document is smoothed by, with their characters, punctuation marks and lines.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_PUNCTUATION, PRIOR_LINES = 100.0, 500.0, 13.0, 4.0
#: Rows' worth of weight of the pooled scatter against a group's own.
POOL_ROWS = 20.0
#: Distance bins: octaves of the squared distance, each cut in eight.
BINS_PER_OCTAVE = 8
MIN_BIN, MAX_BIN = -160, 240
STEPS = 3
#: Chi-square, 4 degrees: median, 0.975 quantile, factor that makes the scatter of the rows within that quantile
#: consistent, and factor of half of a normal sample (small groups are led to it).
MEDIAN, WITHIN, WITHIN_FACTOR, HALF_FACTOR = 3.3567, 11.1433, 1.0645, 2.109
#: Squared Mahalanobis distance beyond which a document is rejected: the 0.999999 quantile of chi-square, 4 degrees,
#: since statistics of short texts have heavier tails than the normal.
CUTOFF = 33.38
#: Group estimates up to this many rows are broadcast; more are joined on a salted key.
BROADCAST_GROUPS = 50_000
SALTS = 64


def _repeat_words(ws: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the text."""
    n = F.size(ws)

    def covered(grams: Column) -> Column:
        def marked(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda s, i: F.coalesce(s["h"] == F.get(pairs, i - 1)["h"], F.lit(False))
                | F.coalesce(s["h"] == F.get(pairs, i + 1)["h"], F.lit(False)),
            )
            at = F.sort_array(F.transform(twice, lambda s: s["p"]))
            total = F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, p: F.struct(
                    (acc["n"] + F.least(F.lit(GRAM), p + GRAM - acc["end"])).alias("n"),
                    (p + GRAM).alias("end"),
                ),
            )
            return total["n"]

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, marked))

    grams = F.transform(
        F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(GRAM)))
    )
    return F.when(n <= GRAM, F.lit(0)).otherwise(let(grams, covered))


def _statistics(text: Column) -> Column:
    """Struct of the base counts of a text, the verdict of the base rules and the transformed vector."""

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n"), _repeat_words(ws).cast("long").alias("r"), F.size(F.array_distinct(ws)).alias("different"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def flat(c: Column) -> Column:
        n = c["w"]["n"]
        prior = n + PRIOR_WORDS
        return F.struct(
            n.alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].alias("n_dup_lines"),
            c["w"]["r"].alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * c["w"]["r"] > REPEAT_PERCENT * n)).alias("base_failed"),
            F.log((c["word_chars"] + PRIOR_CHARS) / prior).alias("x0"),
            F.log((c["punctuation"] + PRIOR_PUNCTUATION) / prior).alias("x1"),
            F.log((c["lines"]["n"] + PRIOR_LINES) / prior).alias("x2"),
            F.log((c["w"]["different"] + PRIOR_WORDS) / prior).alias("x3"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    counts = F.struct(
        let(words(text), of_words).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))).alias("punctuation"),
        let(lines, of_lines).alias("lines"),
    )
    return let(counts, flat)


def _keys(df: DataFrame) -> tuple[Column, Column]:
    """Language and source as never-null join keys that tell null from the empty string."""
    return (F.coalesce(F.concat(F.lit("="), df["lang"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("="), df["source"].cast("string")), F.lit("")))


#: Entries of vectors are summed as whole numbers of this part, so that sums do not depend on their order.
FIXED = 100_000


def _moments() -> list[Column]:
    """Exact (order-free) sums of the vector's entries and products, in fixed-point."""
    fixed = [F.round(F.col(d) * FIXED).cast("long") for d in DIMS]
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.sum(x).alias(f"s{i}") for i, x in enumerate(fixed)]
    out += [F.sum((x * y).cast("decimal(20,0)")).alias(f"q{i}{j}") for i, x in enumerate(fixed) for j, y in enumerate(fixed) if j <= i]
    return out


_PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
_MOMENT_NAMES = ["n"] + [f"s{i}" for i in range(len(DIMS))] + [f"q{i}{j}" for i, j in _PAIRS]


def _cholesky(sums: DataFrame, factor: float = 1.0) -> DataFrame:
    """Centre, lower Cholesky factor of the shrunk scatter and log-determinant, from moment sums by (kl, ks, start)."""
    p = len(DIMS)
    n = F.col("n").cast("double")
    centred = sums.select(
        "kl", "ks", "start", n.alias("n"),
        *((F.col(f"s{i}").cast("double") / n / FIXED).alias(f"m{i}") for i in range(p)),
        *((factor * (F.col(f"q{i}{j}").cast("double") / n - F.col(f"s{i}").cast("double") / n * (F.col(f"s{j}").cast("double") / n)) / FIXED**2).alias(f"c{i}{j}") for i, j in _PAIRS),
    )
    # one row for each start
    pooled = centred.groupBy("start").agg(F.sum("n").alias("rows"), *(F.sum(F.col("n") * F.col(f"c{i}{j}")).alias(f"p{i}{j}") for i, j in _PAIRS))
    for i, j in _PAIRS:
        pooled = pooled.withColumn(f"p{i}{j}", (F.col(f"p{i}{j}") + (POOL_ROWS * TARGET[i] if i == j else 0.0)) / (F.col("rows") + POOL_ROWS))
    est = centred.join(F.broadcast(pooled.drop("rows")), "start")
    own = F.least(*(n * F.col(f"c{i}{i}") / (n * F.col(f"c{i}{i}") + POOL_ROWS * F.col(f"p{i}{i}")) for i in range(p)))
    est = est.withColumn("own_share", own)
    for i, j in _PAIRS:
        est = est.withColumn(f"c{i}{j}", (n * F.col(f"c{i}{j}") + POOL_ROWS * F.col(f"p{i}{j}")) / (n + POOL_ROWS))
    for j in range(p):
        for i in range(j, p):
            done = reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.lit(0.0))
            rest = F.col(f"c{i}{j}") - done
            est = est.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, k: a + F.log(F.col(f"l{k}{k}")), range(p), F.lit(0.0))
    return est.withColumn("logdet", 2 * logdet).select("kl", "ks", "start", "n", "logdet", "own_share", *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i, j in _PAIRS))


def _distance(vector: list[Column], est: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    ys: list[Column] = []
    for i, x in enumerate(vector):
        done = reduce(lambda a, k: a + F.col(f"{est}l{i}{k}") * ys[k], range(i), F.lit(0.0))
        ys.append((x - F.col(f"{est}m{i}") - done) / F.col(f"{est}l{i}{i}"))
    return reduce(lambda a, y: a + y * y, ys, F.lit(0.0))


def _by_bin(cells: DataFrame) -> DataFrame:
    """Cells with the number of rows of their group in closer bins, and in all."""
    w = Window.partitionBy("kl", "ks", "start")
    before = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all_n", F.sum("n").over(w))


def _half(cells: DataFrame) -> DataFrame:
    """Moments over the closest bins that together hold half of each group's rows."""
    kept = _by_bin(cells).where("2 * before < all_n")
    return kept.groupBy("kl", "ks", "start").agg(*(F.sum(m).alias(m) for m in _MOMENT_NAMES))


def _bin(d2: Column) -> Column:
    b = F.floor(F.log2(F.greatest(d2, F.lit(1e-12))) * BINS_PER_OCTAVE).cast("int")
    return F.greatest(F.least(b, F.lit(MAX_BIN)), F.lit(MIN_BIN))


def _attach(df: DataFrame, est: DataFrame, small: bool) -> DataFrame:
    """Join group estimates to rows carrying ``kl``, ``ks``: broadcast when small, else on a salted key."""
    if small:
        return df.join(F.broadcast(est), ["kl", "ks"])
    salted = est.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if c in (*DIMS, "text"))), F.lit(SALTS)).cast("int")
    return df.withColumn("salt", salt).join(salted, ["kl", "ks", "salt"]).drop("salt")


def fit(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Robust centre and scatter per (kl, ks) from a table of vectors; also whether it is small enough to broadcast."""
    vectors = vectors.where("not base_failed").select("kl", "ks", *DIMS)
    groups = vectors.select("kl", "ks").distinct().count()
    small = groups <= BROADCAST_GROUPS
    # starts: coordinate-wise medians on a fixed grid, distances in target units, Euclidean and maximum
    grid = vectors.select("kl", "ks", F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.round(F.col(x) * 100).cast("long").alias("v")) for i, x in enumerate(DIMS)))).alias("e"))
    cells = grid.groupBy("kl", "ks", "e.d", "e.v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kl", "ks", "d")
    ranked = cells.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all_n", F.sum("n").over(w))
    median = ranked.where("2 * upto >= all_n").groupBy("kl", "ks").pivot("d", list(range(len(DIMS)))).agg(F.min("v") / 100.0)
    median = table(median.select("kl", "ks", *(F.col(str(i)).alias(f"m{i}") for i in range(len(DIMS)))), "median")
    scaled = [F.abs(F.col(x) - F.col(f"m{i}")) / TARGET[i] ** 0.5 for i, x in enumerate(DIMS)]
    euclid = reduce(lambda a, x: a + x * x, scaled, F.lit(0.0))
    most = F.pow(F.greatest(*scaled), F.lit(2.0))
    starts = F.explode(F.array(F.struct(F.lit(0).alias("start"), _bin(euclid).alias("bin")), F.struct(F.lit(1).alias("start"), _bin(most).alias("bin"))))
    rows = _attach(vectors, median, small).withColumn("e", starts)
    cells = rows.select("kl", "ks", "e.start", "e.bin", *DIMS).groupBy("kl", "ks", "start", "bin").agg(*_moments())
    vector = [F.col(d) for d in DIMS]
    est = table(_cholesky(_half(cells)), "mcd")
    for _ in range(STEPS):
        rows = _attach(vectors, est, small).withColumn("bin", _bin(_distance(vector)))
        cells = rows.groupBy("kl", "ks", "start", "bin").agg(*_moments())
        est = table(_cholesky(_half(cells)), "mcd")
    best = Window.partitionBy("kl", "ks").orderBy("logdet", "start")
    est = est.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    # the median distance makes the half's scatter consistent; of few rows it says little, and the factor of a normal sample leads
    rows = _attach(vectors, est, small).withColumn("bin", _bin(_distance(vector)))
    cells = _by_bin(rows.groupBy("kl", "ks", "start", "bin").agg(F.count(F.lit(1)).alias("n")))
    median = F.pow(F.lit(2.0), (F.max("bin") + 0.5) / BINS_PER_OCTAVE)
    factor = (F.first("all_n") * median / MEDIAN + POOL_ROWS * HALF_FACTOR) / (F.first("all_n") + POOL_ROWS)
    factors = cells.where("2 * before < all_n").groupBy("kl", "ks").agg(factor.alias("factor"))
    est = table(est.join(factors, ["kl", "ks"]), "mcd")
    rows = _attach(vectors, est, small).where(_distance(vector) <= WITHIN * F.col("factor"))
    final = _cholesky(rows.groupBy("kl", "ks", "start").agg(*_moments()).withColumn("start", F.lit(0)), WITHIN_FACTOR)
    return table(final.drop("start", "logdet").withColumnRenamed("n", "n_within"), "mcd"), small


def _counted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as (whole, kl, ks) with their counts and vectors, worked out once however they are used later."""
    kl, ks = _keys(docs)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), F.coalesce(docs["text"], F.lit("")).alias("text"), kl.alias("kl"), ks.alias("ks"))
    return bind(packed, "stats", _statistics(F.col("text"))).select("whole", "kl", "ks", "stats.*")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, lang, source)."""
    stats = table(_counted(docs.select("doc_id", "text", "lang", "source")).select("whole.doc_id", "*").drop("whole"), "quality")
    est, small = fit(stats)
    failed = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    rest = _attach(stats.where("not base_failed"), est, small).withColumn("distance", _distance([F.col(d) for d in DIMS]))
    out = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance")
    both = failed.select(*out).unionByName(rest.select(*out))
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))


def keep(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows are written once beside their vectors, so nothing is worked out twice and texts are never shuffled.
    """
    rows = table(_counted(docs), "quality")
    est, small = fit(rows)
    near = _attach(rows.where("not base_failed").select("whole", "kl", "ks", *DIMS), est, small).where(_distance([F.col(d) for d in DIMS]) <= cutoff)
    return near.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
