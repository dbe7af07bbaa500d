"""Secret scans with an incremental ledger of blobs.

Every version of a document is content-addressed (SHA-256 of its text).  The ledger is a table
in a folder: one row per (blob, rule version) that was scanned, with the spans found.  A scan

1. maps paths to blobs (narrow rows, written as a table);
2. takes the blobs whose (blob, rule version) pair the ledger does not hold, one path for each;
3. fetches the texts of those paths only and scans them with the rules;
4. appends the results to the ledger as one committed batch;
5. joins the findings of all blobs back to all their paths.

The number of copies or versions of a text does not matter for the scan, and a second scan of
the same versions reads no text.  A changed rule set is a new rule version, so its pairs are
unseen.  All is DataFrame operations: a text is cut by ``split`` and the matches are taken by
``regexp_extract_all``; offsets are running sums of their lengths over the matches of a blob, so
any number of matches in a text takes linear time.

A null text is empty.  Null paths are kept as rows of their own and repeated rows stay
repeated; paths that occur with several texts have the findings of each.  An empty table gives no rows and leaves the
ledger as it is.  Other columns are not read by :func:`scan`; :func:`redact` keeps them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import free_name, written

# The three base patterns, each with its kind and the shortest value that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` (0: the match) has ``least`` characters or more.
    ``cheap`` is a pattern that every text with such a match contains."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    cheap: str | None = None


BASE = (Rule("assign", ASSIGN, 12, 2, r"(?i:password|passwd|secret|token|api_?key)[\"'\x20]*[:=]"),
        Rule("access", ACCESS, 18, 0, r"AKIA[A-Z0-9]{14}"),
        Rule("hex", HEX, 16, 0, r"[0-9a-f]{16}"))
# Further kinds: tokens with a public prefix, and key blocks.
MORE = (Rule("github", r"gh[opsru]_[A-Za-z0-9]+", 40, 0, r"gh[opsru]_[A-Za-z0-9]{36}"),
        Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0, r"xox[abprs]-[A-Za-z0-9-]{10}"),
        Rule("google", r"AIza[A-Za-z0-9_-]+", 39, 0, r"AIza[A-Za-z0-9_-]{35}"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
        Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, r"-----BEGIN [A-Z ]*PRIVATE KEY"))
RULES = BASE + MORE
RULE_VERSION = "base-1+more-1"

SPANS = "array<struct<kind:string,start:int,end:int>>"


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text) -> (blob, spans) for the blobs that have any; spans by start, then
    kind in the rules' order; code points, end exclusive."""
    text = F.col("text")
    cut = lambda r: F.struct(
        F.lit(r.kind).alias("kind"), F.lit(rules.index(r)).alias("place"), F.lit(r.least).alias("least"),
        F.transform(F.split(text, r.pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, _literal(r.pattern), F.lit(0)), F.length).alias("sizes"),
        F.transform(F.regexp_extract_all(text, _literal(r.pattern), F.lit(r.group)), F.length).alias("values"))
    # the cheap pattern goes first: the lists are made only for texts that can have a finding
    found = F.filter(F.array(*[F.when(text.rlike(r.cheap or r.pattern), cut(r)) for r in rules]),
                     lambda x: x.isNotNull())
    lists = blobs.withColumn("found", found).filter(F.size("found") > 0).select("blob", F.explode("found").alias("m"))
    # one row per match; the gap in front of it and its size give its place
    rows = lists.select("blob", "m.kind", "m.place", "m.least", F.posexplode(
        F.arrays_zip(F.slice("m.gaps", F.lit(1), F.size("m.sizes")).alias("gap"), F.col("m.sizes").alias("size"),
                     F.col("m.values").alias("value"))).alias("n", "x"))
    rows = rows.select("blob", "kind", "place", "least", "n", "x.gap", "x.size", "x.value")
    before = Window.partitionBy("blob", "place").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    spans = placed.filter("value >= least").groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("end") - F.col("size")).alias("start"), "place", "end", "kind"))).alias("s"))
    return spans.select("blob", F.transform("s", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPANS).alias("spans"))


class Ledger:
    """Scanned (blob, rule version) pairs with their spans, in batches below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    SCHEMA = f"blob binary, version string, spans {SPANS}"

    def read(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        if not there:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def append(self, scanned: DataFrame) -> None:
        """One batch; it appears whole or not at all, and a retried task replaces its own files."""
        scanned.select("blob", "version", "spans").write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob) of every version."""
    return versions.select(F.col(f"`{path_col}`").alias("path"),
                           F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).alias("blob"))


def update(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger has not seen; returns (path, blob) of all versions."""
    paths = written(addressed(versions, path_col, text_col), "paths")
    seen = ledger.read().filter(F.col("version") == version).select("blob")
    # paths may be null or repeated: any row of the blob will do, as it is checked by content
    unseen = written(paths.groupBy("blob").agg(F.min("path").alias("path"), F.count_if(F.col("path").isNull())
                                               .alias("nameless")).join(seen, "blob", "left_anti"), "unseen")
    if not unseen.limit(1).count():
        return paths
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = versions.select(F.col(f"`{path_col}`").alias("path"), text.alias("text"))
    named = unseen.filter("path is not null").select("path", "blob")
    # the narrow side is the build side, so the texts are neither sorted nor kept in memory
    fetched = texts.join(named.hint("shuffle_hash"), "path").filter(F.unhex(F.sha2("text", 256)) == F.col("blob"))
    nameless = texts.filter("path is null").select("text", F.unhex(F.sha2("text", 256)).alias("blob"))
    nameless = nameless.join(unseen.filter("path is null").select("blob"), "blob").dropDuplicates(["blob"])
    blobs = fetched.select("blob", "text").union(nameless.select("blob", "text"))
    found = written(scan_texts(blobs, rules).dropDuplicates(["blob"]), "found")
    ledger.append(unseen.select("blob").join(found, "blob", "left").select(
        "blob", F.lit(version).alias("version"), F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")))
    return paths


def scan(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """(path, spans) of every version, after the ledger was brought up to date."""
    paths = update(versions, ledger, path_col, text_col, rules, version)
    return paths.join(findings(ledger, version), "blob", "left").select(
        "path", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def findings(ledger: Ledger, version: str = RULE_VERSION) -> DataFrame:
    """(blob, spans) of the blobs with any; a blob scanned twice by jobs that ran at once counts once."""
    return (ledger.read().filter((F.col("version") == version) & (F.size("spans") > 0))
            .select("blob", "spans").dropDuplicates(["blob"]))


def redact(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
           mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """``versions`` with every found span replaced by ``mask`` (overlapping spans by one)."""
    update(versions, ledger, path_col, text_col, rules, version)
    blob, spans = free_name(versions, "_blob"), free_name(versions, "_spans")
    text = F.col(f"`{text_col}`")
    keyed = versions.withColumn(blob, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    joined = keyed.join(findings(ledger, version).select(F.col("blob").alias(blob), F.col("spans").alias(spans)),
                        blob, "left")
    done = lambda a, out, at: F.struct(out.alias("out"), at.alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(F.col(spans), start, lambda a, x: F.when(
        x["end"] <= a["at"], a).when(
        x["start"] < a["at"], done(a, a["out"], x["end"])).otherwise(
        done(a, F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask)), x["end"])),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    columns = [F.when(F.col(spans).isNotNull(), masked).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
               for c in versions.columns]
    return joined.select(*columns)
