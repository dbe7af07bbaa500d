"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by templates.

Training (bounded: fixed notices, ``variants`` altered copies of each, and the paragraphs of
``negative_docs`` documents): sparse word 2- and 3-grams, multinomial logistic regression with an L1
penalty over the licence families, ``unknown`` (licence sentences of no known family) and
``none``.  A quarter of the variants is held out; on it the temperature of the probabilities is
chosen (least log loss), and the probability below which a family becomes ``unknown`` (most right
answers).

All n-grams of the notices are features, whatever words the corpus uses: how often the sample's
paragraphs hold an n-gram is left to the fitted weights.  A sample paragraph that shares half of
``confirm`` with a notice may be one and teaches nothing.

Scan.  Every line of every whole text is a paragraph.  Only n-grams that speak for a licence
(their weight for some licence class exceeds their weight for ``none``) can move a paragraph away
from ``none``.  Each line is tested in the task that reads it: first for a marker word (a word of
such an n-gram that the sample lacks) or an n-gram without one, then with all its n-grams, whose
weights must outweigh the intercept of ``none``.  A line that fails keeps ``none``; this is no approximation.  The other
paragraphs are scored once per distinct text: n-grams joined to the weights (at most ``features``
rows, broadcast), sums per class, softmax.  A family is confirmed by comparing n-grams with its templates: the share of the
smaller set that is common must reach ``confirm``; else the paragraph is ``unknown``.

Only DataFrame and ML functions run.  Null and empty texts have no findings; repeated rows and null ids keep their
rows; an empty table gives no rows (and no paragraphs to learn ``none`` from); other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.common import written
from corpusgauge.llm.license_data import TEMPLATES, UNKNOWN


@dataclass(frozen=True)
class LicenseParams:
    variants: int = 24          # altered copies of each notice
    negative_docs: int = 400    # documents whose paragraphs teach ``none``
    features: int = 4096        # n-grams at most
    penalty: float = 0.0004
    confirm: float = 0.6        # common n-grams by the smaller set


def words(text: Column) -> Column:
    """Lower-case words; punctuation separates, but . and - inside a word stay (2.0, by-nc)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def ngrams(w: Column) -> Column:
    """Distinct 2- and 3-grams of an array of words (the words themselves if there are fewer)."""
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, k)))
    return F.array_distinct(F.when(F.size(w) > 2, F.concat(runs(2), runs(3))).when(F.size(w) == 2, runs(2)).otherwise(w))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    # the words are bound once, in a lambda: a filter on the n-grams then makes them once as well
    return df.withColumn("grams", F.transform(F.array(words(F.col(text))), ngrams)[0])


def templates(spark: SparkSession) -> DataFrame:
    """(label, template, text): the notices, numbered."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("unknown", t) for t in UNKNOWN]
    return spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(rows)], "label string, template int, text string")


def altered(notices: DataFrame, p: LicenseParams) -> DataFrame:
    """Copies of the notices with words left out and foreign words around them; copy 0 is exact."""
    spark = notices.sparkSession
    copies = notices.crossJoin(F.broadcast(spark.range(p.variants).select(F.col("id").cast("int").alias("copy"))))
    w = F.split("text", " ")
    left_out = F.filter(w, lambda x, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(x, i, F.col("copy")), F.lit(20)) > 0))
    around = lambda side: F.when(F.pmod(F.xxhash64("template", "copy", F.lit(side)), F.lit(3)) == 0, F.concat_ws(
        " ", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(
            F.lit("x"), F.hex(F.pmod(F.xxhash64(i, F.col("copy"), F.lit(side)), F.lit(4096)))))))
    return copies.select("label", "template", "copy", F.concat_ws(
        " ", around("front"), F.concat_ws(" ", left_out), around("back")).alias("text"))


def paragraphs(docs: DataFrame, text_col: str, *carry: Column) -> DataFrame:
    """Lines with a letter or digit, numbered from 0 in their text."""
    rows = docs.select(*carry, F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("paragraph_no", "paragraph"))
    return rows.filter(F.col("paragraph").rlike("[A-Za-z0-9]"))


class LicenseModel:
    """Weights (gram, one column per class), the marker words, temperature and threshold;
    ``unmarked`` are the n-grams of evidence without a marker word."""

    def __init__(self, classes, weights, intercepts, markers, temperature, threshold):
        self.classes, self.weights, self.intercepts = classes, weights, intercepts
        self.markers, self.temperature, self.threshold = markers, temperature, threshold
        self.unmarked: list[str] = []

    def evidence(self) -> dict[str, float]:
        """N-grams that speak for a licence, with the most that they add to a class over ``none``."""
        return {g: max(w[1:]) - w[0] for g, *w in self.weights if max(w[1:]) > w[0]}


def train(docs: DataFrame, text_col: str = "text", p: LicenseParams = LicenseParams()) -> LicenseModel:
    spark = docs.sparkSession
    notices = templates(spark)
    samples = altered(notices, p)
    # the documents with the smallest hashes: the same whatever the partitions
    h = F.xxhash64(F.col(f"`{text_col}`"))
    last = docs.select(h.alias("h")).filter(F.col(f"`{text_col}`").isNotNull()).distinct().orderBy("h").limit(
        p.negative_docs).agg(F.max("h")).first()[0]
    plain = paragraphs(docs.filter(h <= F.lit(last)), text_col).select("paragraph").distinct().withColumnRenamed("paragraph", "text")
    plain = written(with_grams(plain, "text"), "licence-plain")
    known = [r.g for r in with_grams(notices, "text").select(F.explode("grams").alias("g")).distinct().collect()]
    # a corpus paragraph that shares much with a notice may be one: it teaches nothing
    near = [F.size(F.array_intersect("grams", F.lit(r.grams))) < p.confirm / 2 * F.least(F.size("grams"), F.lit(len(r.grams)))
            for r in with_grams(notices, "text").select("grams").collect()]
    plain = plain.filter(~F.exists("grams", lambda g: g.isin(known)) | reduce(and_, near))
    rows = with_grams(samples, "text").select("label", "copy", "grams").union(
        plain.select(F.lit("none").alias("label"), F.pmod(F.xxhash64("text"), F.lit(p.variants)).cast("int").alias("copy"), "grams"))
    rows = written(rows.withColumn("held_out", F.col("copy") % 4 == 3), "licence-samples")

    classes = ["none", "unknown", *TEMPLATES]
    index = F.coalesce(*[F.when(F.col("label") == c, F.lit(float(i))) for i, c in enumerate(classes)])
    # features: the notices' n-grams
    rows = rows.withColumn("y", index).withColumn("grams", F.array_intersect("grams", F.lit(known)))
    vectors = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=p.features, binary=True)
    counted = vectors.fit(rows.filter("not held_out and label <> 'none'"))
    rows = counted.transform(rows)
    fit = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=p.penalty, elasticNetParam=1.0,
                             maxIter=150, tol=1e-5, rawPredictionCol="raw")
    model = fit.fit(rows.filter("not held_out"))
    matrix, bias, vocabulary = model.coefficientMatrix.toArray(), model.interceptVector.toArray(), counted.vocabulary
    missing = len(classes) - len(bias)  # classes after the last seen one
    table = [(g, *[float(matrix[c][i]) for c in range(len(bias))], *[0.0] * missing) for i, g in enumerate(vocabulary)
             if abs(matrix[:, i]).max() > 0]
    intercepts = [float(b) for b in bias] + [-20.0] * missing

    # the longest word of each n-gram of evidence that the corpus does not use
    out = LicenseModel(classes, table, intercepts, [], 1.0, 0.0)
    notice_words = sorted({w for g in out.evidence() for w in g.split(" ")})
    corpus_words = {r.w for r in plain.select(F.explode(F.split(F.concat_ws(" ", "grams"), " ")).alias("w")).distinct().filter(
        F.col("w").isin(notice_words)).collect()}
    out.unmarked = sorted(g for g in out.evidence() if corpus_words.issuperset(g.split(" ")))
    out.markers = sorted({min(g.split(" "), key=lambda x: (x in corpus_words, -len(x), x))
                          for g in set(out.evidence()).difference(out.unmarked)})

    held = rows.filter("held_out").select("label", "y", "grams").withColumn("paragraph", F.monotonically_increasing_id())
    scored = written(score(held, out, ["label", "y"]), "licence-held-out")
    truth = F.element_at("scores", F.col("y").cast("int") + 1)
    loss = lambda t: F.sum(F.log(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - truth) / t))))
    steps = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    losses = scored.agg(*[loss(t).alias(str(i)) for i, t in enumerate(steps)]).first()
    out.temperature = min(zip(steps, losses), key=lambda x: x[1] if x[1] is not None else 0.0)[0]
    judged = predicted(scored, out).filter("family <> 'none'")
    cuts = [i / 20 for i in range(20)]
    right = judged.agg(*[F.count_if(F.when(F.col("probability") < c, "unknown").otherwise(F.col("family")) == F.col("label"))
                         .alias(str(i)) for i, c in enumerate(cuts)]).first()
    out.threshold = max(zip(right, cuts))[1] if right else 0.0
    return out


def score(rows: DataFrame, model: LicenseModel, carry: list[str]) -> DataFrame:
    """(paragraph, carry, scores): the class scores of distinct paragraphs with ``grams``."""
    k = len(model.classes)
    weights = rows.sparkSession.createDataFrame(
        model.weights, "gram string, " + ", ".join(f"w{i} double" for i in range(k)))
    grams = rows.select("paragraph", *carry, F.explode_outer("grams").alias("gram"))
    joined = grams.join(F.broadcast(weights), "gram", "left")  # at most ``features`` rows
    return joined.groupBy("paragraph", *carry).agg(F.array(*[
        F.lit(model.intercepts[i]) + F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) for i in range(k)]).alias("scores"))


def with_evidence(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """The rows whose paragraph may have a class other than ``none``: for every class, its
    n-grams of evidence add at most their sum, which must reach what ``none`` is ahead."""
    evidence = model.evidence()
    if not evidence:
        return rows.limit(0)
    ahead = max(0.0, model.intercepts[0] - max(model.intercepts[1:]) - 1e-6)
    gain = F.create_map(*[F.lit(x) for kv in evidence.items() for x in kv])
    hits = F.filter("grams", lambda g: g.isin(list(evidence)))
    return with_grams(rows, "paragraph").filter(
        F.aggregate(hits, F.lit(0.0), lambda a, g: a + F.element_at(gain, g)) > ahead).drop("grams")


def predicted(scored: DataFrame, model: LicenseModel) -> DataFrame:
    """``scored`` with the most probable class and its calibrated probability."""
    best = F.array_max("scores")
    z = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - best) / model.temperature))
    return scored.withColumn("probability", 1 / z).withColumn(
        "family", F.element_at(F.lit(model.classes), F.array_position("scores", best).cast("int")))


def confirmed(found: DataFrame, grams: DataFrame, model: LicenseModel, p: LicenseParams) -> DataFrame:
    """``found`` (paragraph, family, probability) with its best template, the overlap with it and the licence."""
    notices = with_grams(templates(found.sparkSession).filter("label <> 'unknown'"), "text").select(
        F.col("label").alias("family"), "template", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    own = found.join(grams, "paragraph").select("paragraph", "family", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    both = own.join(F.broadcast(notices), ["family", "gram"]).groupBy("paragraph", "template").agg(
        (F.count(F.lit(1)) / F.least(F.first("n"), F.first("size"))).alias("overlap"))
    best = both.groupBy("paragraph").agg(F.max(F.struct("overlap", -F.col("template"))).alias("b")).select(
        "paragraph", F.col("b.overlap").alias("overlap"), (-F.col("b.col2")).alias("template"))
    sure = (F.col("probability") >= model.threshold) & (F.col("overlap") >= p.confirm) & (F.col("family") != "unknown")
    return found.join(best, "paragraph", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0))).withColumn(
        "license", F.when(sure, F.col("family")).otherwise("unknown"))


def scan(docs: DataFrame, model: LicenseModel, text_col: str = "text", id_col: str = "doc_id",
         p: LicenseParams = LicenseParams()) -> DataFrame:
    """One row per licence paragraph: id, paragraph_no, license, family, probability, template, overlap."""
    def marked(c: Column) -> Column:
        found = F.arrays_overlap(F.split(F.lower(c), r"[^a-z0-9.-]+|[.-](?![a-z0-9])|(?<![a-z0-9])[.-]"), F.lit(model.markers).cast("array<string>"))
        grams = "|".join(r"[^a-z0-9]+".join(map(re.escape, g.split(" "))) for g in model.unmarked)
        return found | F.lower(c).rlike(rf"(?<![a-z0-9])(?:{grams})") if grams else found

    rows = paragraphs(docs.filter(marked(F.col(f"`{text_col}`"))), text_col, F.col(f"`{id_col}`").alias("id"))
    rows = written(with_evidence(rows.filter(marked(F.col("paragraph"))), model), "licence-candidates")
    distinct = written(with_grams(rows.select("paragraph").distinct(), "paragraph"), "licence-paragraphs")
    found = predicted(score(distinct, model, []), model).filter("family <> 'none'").select("paragraph", "family", "probability")
    found = written(confirmed(written(found, "licence-predicted"), distinct, model, p), "licences")
    return rows.join(found, "paragraph").select("id", "paragraph_no", "license", "family", "probability", "template", "overlap")
