"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document is the set of its distinct shingles of ``gram`` words (64-bit hashes).  Two
documents link when the intersection holds at least ``percent`` of the union; three
words and 90 unless the caller says otherwise.

1. A count sketch of fixed size, summed over all documents, orders shingles from
   rare to common; any order is correct, this one keeps common passages out of
   prefixes.
2. Equal sets collapse into one class.  Every class has a prefix: so many of its
   first shingles in that order that two linked classes must share one.
3. Classes with identical prefix and size form a group.  Group pairs that share a
   prefix shingle pass size, position and parity-bitmap bounds (all of them
   necessary for a link) before they are expanded and their members verified
   exactly, from the whole texts.
4. Verified links grow components in two rounds.  In the first, each member is
   tried against the most central one of its group, and each group against the
   most central group of its buckets: one pair each, however large a bucket is.  In
   the second, all remaining pairs are tried, but only between different
   components, since a link inside a component changes nothing.

No pair is ever dropped for number's sake.  Buckets, classes and leaders are joined
by shuffles that Spark splits where they are skewed; a leader with many followers is
copied to several keys.  Verification streams: it holds one leader's set at a time.

Defined results: null or wordless texts have no shingles and link with nothing (their
component is their own id); a text of fewer words than a
shingle is one shingle; repeated
rows and equal ids are separate rows of one class; null ids never name a component
unless nothing else can; an empty table gives an empty result; other columns are
ignored by ``components`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import table

#: What links unless the caller says otherwise.
GRAM, PERCENT = 3, 90
CELL_BITS, BLOCKS = 20, 64
#: First-level groups into which partial sketches are summed.
SUM_SALTS = 32
BITMAP = 1024
#: Shingles that more documents than this may hold are dealt out over several keys.
HOT = 20_000
#: Wanted rows up to this many are broadcast to find their texts, more are joined by a shuffle.
BROADCAST_WANTED = 300_000
FOLLOWERS_PER_KEY = 100

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    size = min(gram, len(ws))
    mixed = np.full(len(ws) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(ws) - size + 1 + k]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(texts: DataFrame, gram: int = GRAM) -> np.ndarray:
    """How many documents hold a shingle of each cell."""
    part = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(part, np.int64)
        some = False
        for b in batches:
            for t in b.column(0):
                np.add.at(cells, _cells(shingles(t.as_py(), gram)), 1)
                some = True
        if some:
            rows = cells.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pdf.iloc[:1][["block"]].assign(counts=[total.tobytes()])

    partial = texts.mapInArrow(count, "block int, counts binary").withColumn("salt", F.spark_partition_id() % SUM_SALTS)
    once = partial.groupBy("block", "salt").applyInPandas(add, "block int, counts binary")
    total = np.zeros((BLOCKS, part // BLOCKS), np.int64)
    for row in once.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total, 2**31 - 1).astype(np.int32).ravel()


def _described(docs: DataFrame, key: str, gram: int, percent: int) -> DataFrame:
    """Per row: size, class, group, ordered prefix, parity bitmap, and how common its rarest shingle is."""
    rows = docs.select(docs[key].alias("key"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("text_hash"))
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(rows.select("text"), gram))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        for b in batches:
            n, sig, gid, prefix, bitmap, rare, salts = [], [], [], [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), gram)
                n.append(len(s))
                if not len(s):
                    for x in (sig, gid, prefix, bitmap, rare, salts):
                        x.append(None)
                    continue
                sig.append(_signature(s))
                keep = len(s) - -(-percent * len(s) // 100) + 1
                weight = common[_cells(s)]
                order = np.lexsort((s, weight))[:keep]
                first = s[order]
                prefix.append(first.view(np.int64))
                salts.append(np.where(weight[order] > HOT, weight[order] // (HOT // 2), 0).astype(np.int32))
                gid.append(hashlib.blake2b(first.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
                odd = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
                bitmap.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                rare.append(int(weight.min()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(gid, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32())), pa.array(bitmap, pa.list_(pa.int64())), pa.array(rare, pa.int64())],
                ["key", "text_hash", "n", "sig", "gid", "prefix", "salts", "bitmap", "rare"],
            )

    return rows.mapInArrow(run, f"key {kind}, text_hash long, n long, sig binary, gid binary, prefix array<long>, salts array<int>, bitmap array<long>, rare long")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _bitmaps_fit(x: str, y: str, a: Column, b: Column, percent: int) -> Column:
    """Parities differ in at most as many bits as the sets differ in elements."""
    bits = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITMAP // 64)), F.lit(0))
    return bits <= (a + b - 2 * _overlap(a, b, percent))


def _verified(docs: DataFrame, key: str, classes: DataFrame, pairs: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link; each class ``a`` leads the classes paired with it."""
    spark = docs.sparkSession
    pairs = table(pairs.select("a", "b").distinct(), "pairs")
    followers = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("f"))
    # ``salt`` spreads a leader's followers over keys of bounded size
    keys = F.ceil(F.col("f") / FOLLOWERS_PER_KEY).cast("int")
    member = pairs.join(followers, "a").select("a", F.pmod(F.xxhash64("b"), keys).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("sig"))
    leader = followers.select("a", F.explode(F.sequence(F.lit(0), keys - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("sig"))
    wanted = leader.unionByName(member).groupBy("sig").agg(F.collect_list(F.struct("a", "salt", "role")).alias("uses"))
    wanted = table(wanted.join(classes.select("sig", F.col("name").alias("wanted_key")), "sig"), "wanted")
    small = wanted.select(F.sum(F.size("uses"))).first()[0] or 0
    texts = docs.select(docs[key].alias("key"), docs["text"].alias("text"))
    hint = F.broadcast(wanted) if small <= BROADCAST_WANTED else wanted
    rows = texts.join(hint, texts["key"].eqNullSafe(hint["wanted_key"])).select(F.explode("uses").alias("use"), "sig", "text").select("use.*", "sig", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead, seen = None, None, None
        for batch in batches:
            a, b = [], []
            for x, salt, role, sig, text in zip(*(batch.column(i) for i in range(5))):
                at, sig = (x.as_py(), salt.as_py()), sig.as_py()
                s = shingles(text.as_py(), gram)
                if _signature(s) != sig:  # another text under the same id
                    continue
                if at != now:
                    now, lead, seen = at, None, None
                if role.as_py() == 0:
                    lead = s
                elif sig != seen and lead is not None and linked(lead, s, percent):
                    seen = sig
                    a.append(at[0])
                    b.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return table(rows.mapInArrow(run, "a binary, b binary"), "links")


def components_of(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of undirected ``edges`` (a, b): the least node of each connected component.

    Alternates large-star and small-star steps, which keep connectivity and end in
    stars; hubs are reduced by partial aggregation and joined back.
    """
    edges = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    last = None
    while (now := mark(edges)) != last:
        last = now
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = table(small, "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots).distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """The slots of prefix shingles that more than one group has, each with the most central group of its bucket.

    This is the one shuffle of all prefixes.  Shingles that the sketch knows to be very
    common are cut into several keys, each with a leader of its own.
    """
    groups = rows.where("gid is not null").groupBy("gid").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("salts").alias("salts"))
    slot = F.arrays_zip(F.col("prefix").alias("shingle"), F.col("salts").alias("salts"))
    slots = groups.select("gid", F.col("n").cast("int").alias("n"), F.col("rare").cast("int").alias("rare"), F.posexplode(slot).alias("pos", "s"))
    salted = F.col("s.salts") > 1
    slots = slots.select("gid", "n", "rare", "pos", F.col("s.shingle").alias("shingle"), F.when(salted, F.pmod(F.xxhash64("gid"), F.col("s.salts")).cast("int")).otherwise(F.lit(-1)).alias("salt"))
    w = Window.partitionBy("shingle", "salt").orderBy(F.desc("rare"), "gid")
    alone = F.lag("gid").over(w).isNull() & F.lead("gid").over(w).isNull() & (F.col("salt") < 0)
    top = F.first(F.struct("gid", "n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = slots.withColumn("alone", alone).withColumn("top", top).where("not alone")
    return table(found.select("shingle", "gid", "n", "pos", F.col("top.gid").alias("a"), F.col("top.n").alias("na")), "shared")


def _first_pairs(classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """One promising pair for every class that has any: with the head of its group, or that of the group that leads most of its group's buckets."""
    heads = table(classes.groupBy("gid").agg(F.min("sig").alias("sig"), F.min_by("bitmap", "sig").alias("bitmap")), "heads")
    inside = classes.select("gid", F.col("sig").alias("b")).join(heads.select("gid", F.col("sig").alias("a")), "gid").where("a <> b").select("a", "b")
    tried = shared.where(F.col("a") != F.col("gid")).where(_sizes_fit(F.col("n"), F.col("na"), percent))
    votes = tried.groupBy("gid", "n", "a", "na").agg(F.count(F.lit(1)).alias("votes"))
    own = heads.select("gid", "bitmap", F.col("sig").alias("sig_b"))
    other = heads.select(F.col("gid").alias("a"), F.col("bitmap").alias("bitmap_a"), F.col("sig").alias("sig_a"))
    fit = votes.join(own, "gid").join(other, "a").where(_bitmaps_fit("bitmap", "bitmap_a", F.col("n"), F.col("na"), percent))
    best = fit.groupBy("sig_b").agg(F.max_by("sig_a", F.struct("votes", "a")).alias("a"))
    return inside.unionByName(best.select("a", F.col("sig_b").alias("b")))


def _cross_pairs(classes: DataFrame, shared: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components that share a prefix shingle and pass the bounds.

    Those of one group share all of its prefix, also where no other group has a shingle of it.
    """
    named = classes.join(comps.select(F.col("node").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = table(named.select("sig", "gid", "comp", "n", "bitmap"), "named")
    slots = shared.select("shingle", "gid", "n", "pos").join(named.select("gid", "comp").distinct(), "gid")
    slots = table(slots, "slots")
    # shingles of one component only have nothing more to give
    mixed = slots.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    slots = table(slots.join(mixed, "shingle"), "slots")
    ranges = slots.groupBy("shingle", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"))
    x, y = ranges.alias("x"), ranges.alias("y")
    # bounds that some pair of members must pass; exact where a component has one group in the bucket
    sizes = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    room = F.least(F.col("x.high") - F.col("x.pos"), F.col("y.high") - F.col("y.pos")) >= _overlap(F.col("x.low"), F.col("y.low"), percent)
    meet = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") < F.col("y.comp")) & sizes & room)
    meet = meet.select(F.col("x.shingle").alias("shingle"), F.col("x.comp").alias("comp"), F.col("y.comp").alias("comp_b"))
    one = meet.join(slots, ["shingle", "comp"]).select("shingle", F.col("comp").alias("comp_a"), F.col("comp_b").alias("comp"), F.col("gid").alias("gid_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    two = one.join(slots, ["shingle", "comp"])
    room = 1 + F.least(F.col("n") - 1 - F.col("pos"), F.col("n_a") - 1 - F.col("pos_a"))
    two = two.where(_sizes_fit(F.col("n"), F.col("n_a"), percent) & (room >= _overlap(F.col("n"), F.col("n_a"), percent)))
    groups = two.select("gid_a", "comp_a", F.col("gid").alias("gid_b"), F.col("comp").alias("comp_b"))
    parts = named.select("gid", "comp").distinct()
    inside = parts.select(F.col("gid").alias("gid_a"), F.col("comp").alias("comp_a")).join(parts.select(F.col("gid").alias("gid_b"), F.col("comp").alias("comp_b")), F.expr("gid_a = gid_b AND comp_a < comp_b"))
    groups = groups.unionByName(inside).distinct()
    a = named.select(F.col("gid").alias("gid_a"), F.col("comp").alias("comp_a"), F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bitmap_a"))
    b = named.select(F.col("gid").alias("gid_b"), F.col("comp").alias("comp_b"), F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bitmap_b"))
    pairs = groups.join(a, ["gid_a", "comp_a"]).join(b, ["gid_b", "comp_b"])
    return pairs.where(_bitmaps_fit("bitmap_a", "bitmap_b", F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _least_named(key: Column, text_hash: Column) -> Column:
    """Aggregate: the least (key, text_hash), one without a key only if there is no other."""
    name = F.struct(key.alias("key"), text_hash.alias("text_hash"))
    return F.coalesce(F.min(F.when(key.isNotNull(), name)), F.min(name))


def _classified(docs: DataFrame, key: str, gram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and for every class (sig, ``of``: least key of its component and the hash of that row's text)."""
    rows = table(_described(docs, key, gram, percent), "shingled")
    least = _least_named(F.col("key"), F.col("text_hash"))
    classes = rows.where("sig is not null").groupBy("sig").agg(least.alias("least"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bitmap").alias("bitmap"))
    classes = table(classes.withColumn("name", F.col("least.key")), "classes")
    shared = _shared(rows)
    links = _verified(docs, key, classes, _first_pairs(classes, shared, percent), gram, percent)
    comps = components_of(links)
    more = _verified(docs, key, classes, _cross_pairs(classes, shared, comps, percent), gram, percent)
    comps = components_of(links.unionByName(more))
    named = classes.select("sig", "least").join(comps.select(F.col("node").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    of = named.groupBy("comp").agg(_least_named(F.col("least.key"), F.col("least.text_hash")).alias("of"))
    return rows, named.join(of, "comp").select("sig", "of")


def components(docs: DataFrame, key: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Size of the shingle set and component of every row of ``docs`` (key, text)."""
    rows, classes = _classified(docs, key, gram, percent)
    out = rows.select("key", "n", "sig").join(classes, "sig", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("of.key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``: that of the least key (then least text hash); rows without shingles all stay.

    Rows are told apart by key and text, so rows of one key may part company; of rows equal in both, one stays.
    """
    rows, classes = _classified(docs, key, gram, percent)
    first = F.col("key").eqNullSafe(F.col("of.key")) & (F.col("text_hash") == F.col("of.text_hash"))
    rows = rows.where("sig is not null").select("key", "text_hash", "sig").join(classes, "sig").select("key", "text_hash", first.alias("first"))
    every = rows.groupBy("key", "text_hash").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    marked = table(every.where("n > 1 or not first").select(F.col("key").alias("its_key"), F.col("text_hash").alias("its_hash"), "first"), "marked")
    small, again = marked.count() <= BROADCAST_WANTED, marked.where("first").limit(1).count() > 0
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs[key].alias("key"), F.xxhash64(docs["text"]).alias("text_hash"))
    hint = F.broadcast(marked) if small else marked
    on = packed["key"].eqNullSafe(hint["its_key"]) & (packed["text_hash"] == hint["its_hash"])
    joined = packed.join(hint, on, "left")
    kept = joined.where(F.col("first").isNull()).select("whole")
    if again:
        kept = kept.unionByName(joined.where("first").dropDuplicates(["key", "text_hash"]).select("whole"))
    return kept.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
