"""Retrieval plans (J8-J10, J13, J14, S33) over ``conversations``, ``documents``,
``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.text import WS_RUN_REGEX
from corpusgauge.operators import classify as C
from corpusgauge.operators import retrieval as RT
from corpusgauge.operators.common import shared_table
from corpusgauge.operators.vector_index import VectorIndex
from corpusgauge.plans.classify_plans import classify_sql
from corpusgauge.plans.registry import load, query, sql_list, sql_str
from corpusgauge.session import scratch_path

KB_VALUES = ", ".join(f"({i}, {sql_str(s)}, {sql_str(t)}, {sql_list(tags)})"
                      for i, (s, t, tags) in enumerate(X.KB_SECTIONS))


@query("category_sections", f"""
WITH c AS ({classify_sql('conversations', 'conv_id, turn')}),
cc AS (SELECT conv_id, category, min(turn) AS first_turn FROM c GROUP BY ALL),
keys AS (SELECT conv_id, category, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, category) AS cat_pos FROM cc),
kb(kb_ord, id, section, applicable_for) AS (VALUES {KB_VALUES}),
s AS (SELECT k.conv_id, k.category, k.cat_pos, kb.id, kb.kb_ord, kb.section FROM keys k JOIN kb
      ON (k.category <> 'unknown' AND list_contains(kb.applicable_for, k.category))
      OR (k.category = 'unknown' AND NOT list_contains(kb.applicable_for, 'all'))
      OR list_contains({sql_list(X.KB_ALWAYS)}, kb.id)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY cat_pos, kb_ord) AS r FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cat_pos, kb_ord) AS pos FROM f WHERE r = 1),
q AS (SELECT conv_id, section, min(pos) AS pos FROM p GROUP BY ALL),
t AS (SELECT conv_id, string_agg(section, '; ' ORDER BY pos) AS titles FROM q GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_sections, string_agg(id, ',' ORDER BY p.pos) AS section_ids,
       length(string_agg(section, chr(10) || chr(10) ORDER BY p.pos))::BIGINT AS context_chars, any_value(titles) AS titles
FROM p JOIN t USING (conv_id) GROUP BY conv_id""", ops="J8 J9 J10 S33 U4")
def category_sections(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    c = C.classify_text(conv, "text").select("conv_id", "turn", "category")
    cc = c.groupBy("conv_id", "category").agg(F.min("turn").alias("first_turn"))
    keys = cc.withColumn("cat_pos", F.row_number().over(
        Window.partitionBy("conv_id").orderBy("first_turn", "category")))
    kb = RT.kb_sections(spark)
    # bounded groups of a few sections, read by the three columns of the result
    secs = shared_table(RT.multi_category_sections(keys, kb, ["conv_id"], "category", "cat_pos"), "sections")
    ctx = RT.prompt_context(secs, ["conv_id"])
    titles = RT.readable_titles(secs, ["conv_id"]).select("conv_id", F.array_join("titles", "; ").alias("titles"))
    ids = secs.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]), ",").alias("section_ids"))
    return ctx.join(ids, "conv_id").join(titles, "conv_id").select(
        "conv_id", F.col("n_sections").cast("bigint").alias("n_sections"), "section_ids",
        F.length("context").cast("bigint").alias("context_chars"), "titles")


WORDS_SQL = (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(@C@, '')), "
             f"{sql_str(WS_RUN_REGEX)}), lambda w: length(w) > 0))")


@query("lexical_retrieval", f"""
WITH qw AS (SELECT DISTINCT item_id, unnest({WORDS_SQL.replace('@C@', 'text')}) AS w FROM benchmark),
dw AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL.replace('@C@', 'text')}) AS w FROM documents),
p AS (SELECT item_id, doc_id, count(*) AS score FROM qw JOIN dw USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 3""", ops="J13")
def lexical_retrieval(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").select("item_id", "text")
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return RT.lexical_overlap(q, "item_id", "text", d, "doc_id", "text", 3)


def label_centroids(spark, sf_dir):
    """Query vectors derived from the data: the mean embedding of each label."""
    e = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))),
                                              lambda s: s["x"]).alias("qv"))


@query("vector_topk", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 1 + (SELECT max(len(v)) FROM e)) g(i)
      WHERE i <= len(v) GROUP BY label, i),
q AS (SELECT label, list(x ORDER BY i) AS qv FROM x GROUP BY label),
s AS (SELECT q.label, e.vec_id,
             list_dot_product(e.v, q.qv) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.qv, q.qv))) AS sim
      FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT label, rank::INTEGER AS rank, vec_id, round(sim, 3) AS similarity FROM r WHERE rank <= 3""", ops="J14")
def vector_topk(spark, sf_dir):
    corpus = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return RT.cosine_top_k(corpus, "vec_id", "embedding", label_centroids(spark, sf_dir), "label", "qv", 3)


NEIGHBOURS = 10   # of each vector whose id is divisible by 100
PROBES = 0.7      # share of the lists that the inexact search visits: the vectors have little structure


def _indexed(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.build(vectors, "vec_id", "embedding", scratch_path(spark, "vector-index"))
    return index, vectors.filter(F.col("vec_id") % 100 == 0)


@query("vector_index_topk", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS vec_id, e.vec_id AS neighbour_id,
             list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS sim
      FROM e q JOIN e ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, neighbour_id) AS rank FROM s)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(sim, 6) AS similarity FROM r WHERE rank <= {NEIGHBOURS}""", ops="J14")
def vector_index_topk(spark, sf_dir):
    """The exact search of the stored index."""
    index, queries = _indexed(spark, sf_dir)
    return index.search(queries, "vec_id", "embedding", NEIGHBOURS, PROBES, exact=True).select(
        F.col("qid").alias("vec_id"), "rank", F.col("did").alias("neighbour_id"), F.round("sim", 6).alias("similarity"))


@query("vector_index_recall", f"""
SELECT count(*)::BIGINT AS n_queries,
       (count(*) * least({NEIGHBOURS}, (SELECT count(*) FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)))::BIGINT AS n_neighbours,
       true AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL""", ops="J14")
def vector_index_recall(spark, sf_dir):
    """Of the exact neighbours of all queries, the share that the inexact search finds: 0.9 or more."""
    index, queries = _indexed(spark, sf_dir)
    true = index.search(queries, "vec_id", "embedding", NEIGHBOURS, PROBES, exact=True)
    found = index.search(queries, "vec_id", "embedding", NEIGHBOURS, PROBES).select("qid", "did", F.lit(1).alias("found"))
    return true.join(found, ["qid", "did"], "left").agg(
        F.countDistinct("qid").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))
