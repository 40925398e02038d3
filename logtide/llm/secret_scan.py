"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  Each rule
belongs to a rule version, the release that brought it.  Only pairs of blob and rule
version that the ledger has not yet seen are scanned: a new blob under all versions,
a known one under new versions alone.  Findings belong to blobs and are joined back
to all paths that hold them.

A span is the whole match of a rule, in code points, end exclusive.  Matches of
one kind are leftmost and non-overlapping; a match that fails its rule's length
condition still uses up its characters.

Texts are shuffled once, to collapse equal blobs (copies are collapsed before the
shuffle as well); findings are broadcast to the paths while they are few, and beyond
that only digests that few rows hold are shuffled.

Defined results: null text is the empty text; repeated rows and equal texts get
equal findings; an empty table gives an empty result; texts of any length are
scanned whole; other columns are ignored by ``scan`` and kept by ``redact``.

All of it is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import folder, join_by_count, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of one of its groups (0: the match), and the rule version that brought it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", version=2),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", version=2),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", version=2),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[SECRET]"


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, order: int, rule: Rule) -> Column:
    """Array of (kind order, k, length of the gap before, length, whether the length condition holds)."""
    kind = F.struct(
        F.lit(0).alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")
    )
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.transform(
        F.arrays_zip(whole.alias("whole"), checked.alias("checked"), F.slice(gaps, 1, F.size(whole)).alias("gap")),
        lambda m, k: F.struct(
            F.lit(order).alias("kind"),
            k.alias("k"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("len"),
            (F.length(m["checked"]) >= rule.least).alias("ok"),
        ),
    )
    return F.when(text.rlike(rule.pattern), rows).otherwise(F.array_remove(F.array(kind), kind))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per finding of ``blobs`` (digest, text, and in ``todo`` the rule versions to run): digest, kind (index into ``rules``), start, end."""
    none = F.array_remove(F.array(F.lit(0)), 0)
    empty = F.transform(none, lambda _: F.struct(F.lit(0).alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")))
    found = F.concat(*(F.when(F.array_contains("todo", r.version), _matches(F.col("text"), i, r)).otherwise(empty) for i, r in enumerate(rules)))
    rows = blobs.select("digest", F.explode(found).alias("m")).select("digest", "m.*")
    w = Window.partitionBy("digest", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    return rows.withColumn("end", end).where("ok").select("digest", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


class BlobLedger:
    """Which blobs have been scanned under which rule versions, and what was found, as two Parquet tables at ``path``."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def fresh(cls, spark) -> BlobLedger:
        """An empty ledger in the shared folder."""
        return cls(spark, folder(spark, "secret-ledger"))

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        if there:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.range(0).select(*(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")))

    def scanned(self) -> DataFrame:
        return self._read("scanned", "digest string, rule_version int")

    def findings(self) -> DataFrame:
        return self._read("findings", "digest string, kind string, start long, end long")

    def _todo(self, blobs: DataFrame, versions: list[int]) -> DataFrame:
        """``blobs`` with the rule versions that the ledger has not seen them under, if any."""
        seen = self.scanned().where(F.col("rule_version").isin(versions)).groupBy("digest").agg(F.collect_set("rule_version").alias("seen"))
        every = F.array(*(F.lit(v) for v in versions))
        todo = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))
        return blobs.join(seen, "digest", "left").withColumn("todo", todo).drop("seen").where(F.size("todo") > 0)

    def update(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the blobs of ``texts`` under the versions of ``rules`` not yet seen, record both, and return all findings of these rules.

        Findings are written before the pairs are marked as scanned, so a run cut
        short between the two repeats work instead of losing findings; readers
        drop what was then written twice.
        """
        versions = sorted({r.version for r in rules})
        kinds = F.array(*(F.lit(r.kind) for r in rules))
        found = scan_blobs(self._todo(distinct_blobs(texts), versions), rules)
        # texts are read again for their digests, which is less than keeping the unseen ones
        digests = texts.select(digest(texts["text"]).alias("digest")).distinct()
        pairs = self._todo(digests, versions).select("digest", F.explode("todo").alias("rule_version"))
        found.select("digest", F.get(kinds, F.col("kind")).alias("kind"), F.col("start").cast("long"), F.col("end").cast("long")).write.mode("append").parquet(f"{self.path}/findings")
        pairs.write.mode("append").parquet(f"{self.path}/scanned")
        order = F.array_position(kinds, F.col("kind")).cast("int") - 1
        return self.findings().where(F.col("kind").isin([r.kind for r in rules])).distinct().withColumn("kind", order)


def distinct_blobs(texts: DataFrame) -> DataFrame:
    """Each different text once, under its address."""
    text = F.coalesce(texts["text"], F.lit(""))
    return texts.select(digest(texts["text"]).alias("digest"), text.alias("text")).dropDuplicates(["digest"])


def _listed(spans: Column, names: list[str]) -> Column:
    kinds = F.array(*(F.lit(x) for x in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def scan(versions: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None) -> DataFrame:
    """Findings of every row of ``versions`` (path, text): counts and digest of the base kinds, and all spans.  Without a ledger, a fresh one is used."""
    names = [r.kind for r in rules]
    n_base = len(BASE_RULES)
    found = (ledger or BlobLedger.fresh(versions.sparkSession)).update(versions, rules)
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    by_blob = found.groupBy("digest").agg(spans.alias("all"))
    base = F.filter("all", lambda s: s["kind"] < n_base)
    by_blob = by_blob.select(
        "digest",
        *(F.size(F.filter("all", _of_kind(i))).cast("long").alias(f"n_{names[i]}") for i in range(n_base)),
        _listed(base, names).alias("base"),
        _listed(F.col("all"), names).alias("spans"),
    )
    paths = versions.select(versions[path].alias(path), digest(versions["text"]).alias("digest"))
    out = join_by_count(paths, table(by_blob, "secrets"), "digest", size=F.length("base") + F.length("spans") + 100)
    return out.select(
        path,
        *(F.coalesce(f"n_{names[i]}", F.lit(0).cast("long")).alias(f"n_{names[i]}") for i in range(n_base)),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def history(versions: DataFrame, path: str = "doc_id") -> DataFrame:
    """``scan`` of a table that a fresh ledger gets to know in two steps.

    First the rows of one half (by a hash of the path) under the first rule version, then
    all rows under all versions.  The second step runs every rule on the blobs that are
    new, and only the later rules on those known, so no pair is scanned twice.
    """
    ledger = BlobLedger.fresh(versions.sparkSession)
    ledger.update(versions.where(F.pmod(F.xxhash64(versions[path]), F.lit(2)) == 0), BASE_RULES)
    return scan(versions, path, RULES, ledger)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every span replaced by a mask, ``n_chars`` (where there is one) following; texts without findings are untouched.

    Overlapping spans of different kinds are masked once, as their union.
    """
    found = (ledger or BlobLedger.fresh(docs.sparkSession)).update(docs, rules)
    spans = found.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found_spans"))
    names = docs.columns
    packed = docs.select(digest(docs["text"]).alias("digest"), F.struct(*(docs[c] for c in names)).alias("whole"))
    text = F.col("whole")["text"]
    cut = F.aggregate(
        "found_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["end"], F.concat(acc["out"], F.substring(text, (acc["end"] + 1).cast("int"), (s["start"] - acc["end"]).cast("int")), F.lit(MASK))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
    )
    rest = F.concat(cut["out"], F.substring(text, (cut["end"] + 1).cast("int"), F.length(text)))
    new = join_by_count(packed, table(spans, "spans"), "digest", size=16 * F.size("found_spans") + 100).withColumn("masked", F.when(F.col("found_spans").isNull(), text).otherwise(rest))
    fields = {"text": F.col("masked"), "n_chars": F.when(F.col("found_spans").isNull(), F.col("whole")["n_chars"]).otherwise(F.length("masked").cast("long")) if "n_chars" in names else None}
    return new.select(*((fields[c] if fields.get(c) is not None else F.col("whole")[c]).alias(c) for c in names))
