"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.secret_scan import BASE, RULES
from corpusgauge.plans.registry import Query, load, sql_str

_LLM: dict[str, Query] = {}


def llm_query(name: str, sql: str | None = None):
    def deco(fn):
        _LLM[name] = Query(name, fn, sql, name.split("_")[0])
        return fn
    return deco


def llm_queries() -> dict[str, Query]:
    return dict(_LLM)


# A-Z in lower case, and the words of the near-duplicate and quality contracts.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {SPACED}) GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
rep AS (
  SELECT rid, count(DISTINCT pos) AS n FROM (
    SELECT rid, unnest(range(i, i + 8)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1)
  GROUP BY rid),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft_failed FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR soft_failed)::DOUBLE AS x FROM f GROUP BY source),
p AS (
  SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS var FROM h),
s AS (
  SELECT source, n, (x + mean * weight) / (n + weight) AS rate
  FROM h, (SELECT mean, CASE WHEN var > 1e-12 AND mean * (1 - mean) > var THEN mean * (1 - mean) / var - 1 ELSE 1.0 END AS weight FROM p)),
q AS (SELECT sum(rate * n) / sum(n) AS m, sum(rate * rate * n) / sum(n) AS square FROM s),
v AS (SELECT source, rate > m + sqrt(greatest(square - m * m, 0)) + 1e-6 AS host_bad FROM s, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND host_bad) AS kept, soft_failed, host_bad
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


@llm_query("op5_host_quality", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.quality import host_quality

    return host_quality(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "soft_failed", "host_bad")


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
         list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS g
  FROM d),
c AS (SELECT *, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id FROM s),
r AS (SELECT class_id AS id, any_value(g) AS g FROM c WHERE len(g) > 0 GROUP BY class_id),
e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM r),
links AS (
  SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT id, id AS other FROM r UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.other = links.u),
label AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(g) AS n_shingles, coalesce(component_id, class_id) AS component_id,
       doc_id = coalesce(component_id, class_id) AS kept, class_id
FROM c LEFT JOIN label ON c.class_id = label.id AND len(g) > 0
"""


@llm_query("op3_minhash_near_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.minhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id")


@llm_query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusgauge.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"])
    return decode(ids, path, as_text=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


TERMS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {TERMS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {TERMS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
hits AS (
  SELECT rid, i, g.k, item FROM d, (SELECT DISTINCT k FROM g) AS ks, unnest(range(1, len(w) - ks.k + 2)) AS u(i)
  JOIN g ON g.k = ks.k AND g.gram = array_to_string(list_slice(w, i, i + ks.k - 1), ' ')),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


@llm_query("op9_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.decontam import contamination, n_hit

    hits = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def _op6_sql() -> str:
    """Each rule: cut the text at the matches; running sums of the lengths give the places."""
    parts = " UNION ALL ".join(
        f"SELECT rid, {sql_str(r.kind)} AS kind, {place} AS place, {r.least} AS least,"
        f" string_split_regex(t, {sql_str(r.pattern)}) AS gaps, regexp_extract_all(t, {sql_str(r.pattern)}) AS found,"
        f" regexp_extract_all(t, {sql_str(r.pattern)}, {r.group}) AS vals FROM d"
        for place, r in enumerate(RULES))
    base = ", ".join(sql_str(r.kind) for r in BASE)
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({parts}),
m AS (
  SELECT rid, kind, place, least, i, length(found[i]) AS size, length(vals[i]) AS val,
         sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY rid, place ORDER BY i) AS stop
  FROM k, unnest(range(1, len(found) + 1)) AS u(i)),
s AS (SELECT rid, kind, place, stop - size AS start, stop FROM m WHERE val >= least),
a AS (
  SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = {sql_str(r.kind)}) AS n_{r.kind}" for r in BASE)},
         string_agg({text}, ',' ORDER BY start, place) FILTER (WHERE kind IN ({base})) AS base,
         string_agg({text}, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


@llm_query("op6_secret_scan", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.secret_scan import Ledger, scan
    from corpusgauge.session import scratch_path

    found = scan(load(spark, sf_dir, "documents"), Ledger(spark, scratch_path(spark, "ledger")))
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


# A conversation made of the control strings of a common chat template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 2, 'assistant', '{CONTROL_TEXT}'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<>\\[\\]\\\\]', '', 'g'))
            + length(role) + length(regexp_replace(role, '[^<>\\[\\]\\\\]', '', 'g')) + 11 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@llm_query("op10_chat_format", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.chat import format_conversations, masked_texts, read_turns

    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    out = format_conversations(turns.union(extra)).withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@llm_query("op8_html_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.html_main import extract

    return extract(load(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@llm_query("op7_repeated_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.repeats import remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@llm_query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.license_scan import scan, train

    docs = load(spark, sf_dir, "documents")
    return scan(docs, train(docs)).withColumnRenamed("id", "doc_id")


@llm_query("op4_toxicity_chain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.toxicity import score, train

    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""


@llm_query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.hard_negatives import mine

    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    e = e.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"))
    return mine(e, F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
g AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos FROM r),
lists AS (SELECT rid, list(pos) AS pos FROM gone GROUP BY rid),
k AS (
  SELECT d.rid, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) d
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = d.rid AND gone.pos = d.pos) GROUP BY d.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid) LEFT JOIN k USING (rid)
"""


@llm_query("op12_repeated_words", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.substrings import remove_repeated_words

    return remove_repeated_words(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM p, unnest([1, 2, 3]) AS ks(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, a, j, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM c, unnest(range(1, c.k)) AS u(j)
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(list_slice(w, j + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS most
  FROM c, unnest([1, 2]) AS u(i) WHERE k = 3 GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.phrase = i.phrase AND b.k = 2
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000
"""


@llm_query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusgauge.llm.collocations import collocations

    return collocations(load(spark, sf_dir, "documents"))
