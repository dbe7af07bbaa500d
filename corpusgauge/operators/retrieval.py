"""Retrieval operators.

* Category retrieval joins a tiny knowledge-base dimension (broadcast).
* Lexical retrieval sends an inverted index of the queries' words to the tasks (in blocks of
  bounded size); a document is scored in the task that reads it, and only the k best of each
  query leave the task.
* Vector retrieval is exact cosine similarity in the same way, by matrix products of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge import fixed as X
from corpusgauge.functions.text import WS_RUN_JAVA
from corpusgauge.operators.common import top_k


def kb_sections(spark) -> DataFrame:
    rows = [(i, sid, title, tags) for i, (sid, title, tags) in enumerate(X.KB_SECTIONS)]
    return spark.createDataFrame(rows, "kb_ord int, id string, section string, applicable_for array<string>")


def sections_for_category(keys: DataFrame, kb: DataFrame, key_cols, cat_col: str = "category") -> DataFrame:
    """Knowledge-base sections for each (key, category).

    Known category -> sections tagged with it, plus the always-included
    procedural sections; 'unknown' -> every section not tagged 'all', plus the
    always-included ones.  The knowledge base is a fixed dimension of a few sections: it
    becomes an array literal, filtered and exploded next to the keys, without a join."""
    rows = kb.select("kb_ord", "id", "section", "applicable_for").collect()
    sections = F.array(*[F.struct(
        F.lit(r["kb_ord"]).alias("kb_ord"), F.lit(r["id"]).alias("id"), F.lit(r["section"]).alias("section"),
        F.array(*[F.lit(t) for t in r["applicable_for"]]).cast("array<string>").alias("tags"),
        F.lit(r["id"] in X.KB_ALWAYS).alias("always")) for r in rows])
    cat = F.col(cat_col)
    mine = F.filter(sections, lambda s: s["always"] | F.when(
        cat == "unknown", ~F.array_contains(s["tags"], "all")).otherwise(F.array_contains(s["tags"], cat)))
    return keys.withColumn("_s", F.explode(mine)).select(*keys.columns, "_s.id", "_s.kb_ord", "_s.section")


def multi_category_sections(keys: DataFrame, kb: DataFrame, key_cols, cat_col: str = "category",
                            cat_pos: str = "cat_pos") -> DataFrame:
    """Retrieval for several ordered categories per key; a section keeps its
    first position (category order, then knowledge-base order)."""
    s = sections_for_category(keys, kb, key_cols, cat_col)
    w = Window.partitionBy(*key_cols, "id").orderBy(cat_pos, "kb_ord")
    first = s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return first.withColumn("pos", F.row_number().over(
        Window.partitionBy(*key_cols).orderBy(cat_pos, "kb_ord")))


def prompt_context(sections: DataFrame, key_cols, pos_col: str = "pos") -> DataFrame:
    """One text block per key: sections in order, blank line between.
    The group is bounded by the knowledge-base size."""
    return sections.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos_col, "section"))),
                                 lambda s: s["section"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_sections"))


def section_block(sid, section, text, text_english) -> F.Column:
    """A section in a prompt: ``[id] title``, the Bangla text and the English text, a line each;
    what is missing is empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("["), sid, F.lit("] "), part(section), F.lit("\n" + X.CONTEXT_BANGLA), part(text),
                    F.lit("\n" + X.CONTEXT_ENGLISH), part(text_english))


def language_rule(mode) -> F.Column:
    """The rule for the language of the answer."""
    out = F.lit(X.LANGUAGE_RULE_BOTH)
    for name, rule in X.LANGUAGE_RULES.items():
        out = F.when(mode == name, F.lit(rule)).otherwise(out)
    return out


def full_prompt_context(sections: DataFrame, kb: DataFrame, key_cols, pos_col: str = "pos") -> DataFrame:
    """Per key the blocks of its sections in order, a blank line between, and their number.

    ``kb``: (id, text, text_english), one row a section; its blocks are made once, written, and
    joined to the keys' section ids (Spark broadcasts them if what was written is small).  A key's
    group is bounded by the knowledge base."""
    from corpusgauge.operators.common import shared_table

    titles = sections.select("id", "section").distinct()
    blocks = shared_table(titles.join(kb.select("id", "text", "text_english"), "id", "left").select(
        "id", section_block(F.col("id"), F.col("section"), F.col("text"), F.col("text_english")).alias("block")), "section-blocks")
    return sections.select(*key_cols, "id", F.col(pos_col).alias("_pos")).join(blocks, "id").groupBy(*key_cols).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "block"))), lambda s: s["block"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_sections"))


def readable_titles(sections: DataFrame, key_cols, pos_col: str = "pos") -> DataFrame:
    """Per key the section titles in order, each once; a section without a title is
    shown by its id."""
    title = F.coalesce("section", "id")
    return sections.groupBy(*key_cols).agg(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("pos"), title.alias("title")))),
        lambda s: s["title"])).alias("titles"))


def word_set(col) -> F.Column:
    """Distinct lower-cased whitespace words (``str.lower().split()`` as a set)."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), WS_RUN_JAVA),
                                     lambda w: F.length(w) > 0))


# What one block of queries may hold: words (with their postings) and bytes of vectors.
BLOCK_WORDS = 2_000_000
BLOCK_BYTES = 64 << 20


# Scores that a task computes at a time (rows of the corpus times queries).
TILE_SCORES = 4_000_000


class _Keeper:
    """A task's ``k`` best (score descending, id) of each of ``n`` queries: what leaves the task, whatever
    the number of rows it reads."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.n, self.k, self.held, self.size = n, k, [], 0
        self.floor = np.full(n, -np.inf)   # a query's k-th best score; lower ones cannot enter

    def add(self, queries, scores, ids) -> None:
        import pandas as pd

        keep = scores >= self.floor[queries]
        if keep.any():
            self.held.append(pd.DataFrame({"q": queries[keep], "score": scores[keep], "id": ids[keep]}))
            self.size += int(keep.sum())
            if self.size > 2 * self.n * self.k + 200_000:
                self.best()

    def best(self):
        """The rows (q, score, id) kept so far, in order."""
        import pandas as pd

        if not self.held:
            return None
        rows = pd.concat(self.held, ignore_index=True).sort_values(["q", "score", "id"], ascending=[True, False, True])
        rows = rows[rows.groupby("q").cumcount() < self.k]
        self.held, self.size = [rows], len(rows)
        full = rows.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        return rows


def _blocks(df: DataFrame, size: F.Column, limit: int) -> list[DataFrame]:
    """``df`` in blocks of about ``limit`` by the sum of ``size`` (one pass over the queries)."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = 1 + int(total) // limit
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)) == i) for i in range(n)]


def lexical_overlap(queries: DataFrame, qid: str, qtext: str, docs: DataFrame, did: str, dtext: str,
                    k: int = 3) -> DataFrame:
    """Per query the top-k documents by number of distinct shared words (> 0);
    ties by document id.  Output (qid, rank, did, score).

    The queries' words are an inverted index (word -> queries), sent to the tasks in blocks of
    at most ``BLOCK_WORDS`` words.  A document is scored in the task that reads it, against the
    queries that share a word with it, and a task sends on only the k best of each query:
    common words cost time, no shuffle."""
    import numpy as np
    import pandas as pd

    types = f"_qid {dict(queries.dtypes)[qid]}, _did {dict(docs.dtypes)[did]}, score bigint"
    words = queries.filter(F.col(qid).isNotNull()).select(F.col(qid).alias("_qid"), word_set(F.col(qtext)).alias("_w"))
    words = words.filter(F.size("_w") > 0)
    base = docs.select(F.col(did).alias("_did"), word_set(F.col(dtext)).alias("_w"))
    parts = []
    for block in _blocks(words, F.size("_w"), BLOCK_WORDS):
        rows = block.collect()
        index: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for w in r["_w"]:
                index.setdefault(w, []).append(i)
        sent = docs.sparkSession.sparkContext.broadcast(
            ([r["_qid"] for r in rows], {w: np.array(x, np.int64) for w, x in index.items()}))

        def score(batches, sent=sent):
            ids, index = sent.value
            keeper = _Keeper(len(ids), k)
            for pdf in batches:
                dids = pdf["_did"].to_numpy()
                for i, ws in enumerate(pdf["_w"] if ids else []):
                    found = [index[w] for w in ws if w in index]
                    if not found:
                        continue
                    hits = np.concatenate(found)
                    if len(hits) < len(ids) // 8:
                        q, counts = np.unique(hits, return_counts=True)
                    else:
                        counts = np.bincount(hits, minlength=len(ids))
                        q = np.flatnonzero(counts)
                        counts = counts[q]
                    high = counts >= keeper.floor[q]
                    keeper.add(q[high], counts[high], np.repeat(dids[i:i + 1], int(high.sum())))
            best = keeper.best()
            if best is not None:
                yield pd.DataFrame({"_qid": [ids[q] for q in best["q"]], "_did": best["id"].to_numpy(), "score": best["score"].to_numpy()})

        parts.append(base.mapInPandas(score, types))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    ranked = top_k(cand, ["_qid"], [F.col("score").desc(), F.col("_did")], k, "rank")
    return ranked.select(F.col("_qid").alias(qid), "rank", F.col("_did").alias(did), "score")


def cosine_top_k(corpus: DataFrame, cid: str, cvec: str, queries: DataFrame, qid: str, qvec: str,
                 k: int = 3, chunk_rows: int | None = None) -> DataFrame:
    """Exact cosine top-k per query (similarity rounded to 3 decimals, ties
    by corpus id).  Queries with an empty vector return no rows.

    The normalised query vectors go to the tasks in blocks of about ``BLOCK_BYTES`` (or
    ``chunk_rows`` rows), usually one, so the corpus is read once; each batch of the corpus is scored
    by matrix products of at most ``TILE_SCORES`` scores, and a task sends on only the k best of
    each query.  Exact, no cap, and no (corpus x query) rows leave a task."""
    import numpy as np
    import pandas as pd

    q = queries.filter(F.size(qvec) > 0).select(F.col(qid).alias("_qid"), F.col(qvec).alias("_qv"))
    types = f"_qid {dict(queries.dtypes)[qid]}, _cid {dict(corpus.dtypes)[cid]}, _sim double"
    base = corpus.select(F.col(cid).alias("_cid"), F.col(cvec).alias("_cv"))
    parts = []
    size, limit = (8 * F.size("_qv"), BLOCK_BYTES) if chunk_rows is None else (F.lit(1), chunk_rows)
    for block in _blocks(q, size, limit):
        rows = block.collect()
        with np.errstate(divide="ignore", invalid="ignore"):
            qm = np.array([r["_qv"] for r in rows], dtype=np.float64)
            qm = qm / np.linalg.norm(qm, axis=-1, keepdims=True)
        sent = corpus.sparkSession.sparkContext.broadcast(([r["_qid"] for r in rows], qm))

        def score(batches, sent=sent):
            ids, qmat = sent.value
            keeper = _Keeper(len(ids), k)
            for pdf in batches:
                if pdf.empty or not ids:
                    continue
                m = np.stack(pdf["_cv"].to_numpy()).astype(np.float64)
                # A zero vector has no cosine: NaN here, null in Spark, ranked last.
                with np.errstate(divide="ignore", invalid="ignore"):
                    m = m / np.linalg.norm(m, axis=1, keepdims=True)
                cids = pdf["_cid"].to_numpy()
                step = max(1, TILE_SCORES // len(m))
                for start in range(0, len(ids), step):
                    sims = m @ qmat[start:start + step].T
                    sims = np.where(np.isnan(sims), -np.inf, sims)
                    # the batch's k best of each query, with all that tie with the last
                    at = max(len(m) - k, 0)
                    rows, q = np.nonzero(sims >= np.maximum(np.partition(sims, at, axis=0)[at], keeper.floor[start:start + step]))
                    keeper.add(q + start, sims[rows, q], cids[rows])
            best = keeper.best()
            if best is not None:
                sim = best["score"].to_numpy()
                yield pd.DataFrame({"_qid": [ids[q] for q in best["q"]], "_cid": best["id"].to_numpy(), "_sim": np.where(np.isinf(sim), np.nan, sim)})

        parts.append(base.mapInPandas(score, types))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    ranked = top_k(cand, ["_qid"], [F.col("_sim").desc(), F.col("_cid")], k, "rank")
    return ranked.select(F.col("_qid").alias(qid), "rank", F.col("_cid").alias(cid),
                         F.round("_sim", 3).alias("similarity"))


def enriched_kb_documents(kb: DataFrame, keywords: DataFrame) -> DataFrame:
    """S34 + S35: one search document per knowledge-base section: title, Bangla
    text and English text on separate lines, plus the keywords of the
    categories it applies to ('all' excluded), and the law family.

    ``keywords`` is (category, cat_ord, script, keyword, ord) as read by
    ``sources.io.read_keywords``; per-category keyword strings are one small
    aggregate (bounded by the dictionary) joined to the exploded tags."""
    from corpusgauge.functions.normalize import law_family

    cat_words = keywords.groupBy("category").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "keyword"))),
                                 lambda s: s["keyword"]), " ").alias("_words"))
    tags = kb.select("id", F.posexplode("applicable_for").alias("_tpos", "category")).filter(
        F.col("category") != "all")
    enrich = (tags.join(F.broadcast(cat_words), "category")
              .groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_tpos", "_words"))),
                                                          lambda s: s["_words"]), "  ").alias("_enrich")))
    base = F.concat_ws("\n", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")),
                       F.coalesce("text_english", F.lit("")))
    j = kb.join(enrich, "id", "left")
    doc = F.when(F.coalesce(F.col("_enrich"), F.lit("")) != "",
                 F.concat(base, F.lit("\n" + X.KB_ENRICH_PREFIX), F.col("_enrich"))).otherwise(base)
    return j.select("id", doc.alias("document"), F.array_join("applicable_for", ",").alias("applicable_for"),
                    law_family(F.col("id")).alias("law"))
