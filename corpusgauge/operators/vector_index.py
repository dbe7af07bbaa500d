"""A stored inverted-file index for cosine search.

Build.  Coarse centroids are fitted with k-means on a bounded sample (``sample_rows``); every
vector is assigned to its nearest one.  Stored below ``path``:

* ``centroids``  (list, centre, min_cos): the lists, and the cosine of their farthest member;
* ``postings``   (list, ids, vectors): blocks of about ``block`` members, partitioned by list.

Search.  A query meets the ``probes`` lists whose centres are nearest to it: queries are grouped
into blocks per list, blocks of queries are joined with blocks of members on the list, and one
matrix product per pair of blocks scores them (a hot list has many blocks, which a skewed join
can split).  Only the k best of each pair of blocks go on.  Partitions of lists that no query
probes are not read.

The exact way continues: with the k-th best score found, a list is passed over only if no member can reach
it, because a member lies within the list's angle r of the centre and so no nearer to the query
than the angle to the centre minus r.  All other lists are searched as well.

Vectors without a direction (null, empty, zero, or with a null or non-finite component) and rows
without id are not indexed and find nothing.  Repeated ids are separate entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators.common import shared_table, top_k


@dataclass(frozen=True)
class IndexParams:
    lists: int | None = None     # None: the root of the number of vectors, at most max_lists
    max_lists: int = 4096        # bounds what is sent to the tasks: max_lists * dimension doubles
    sample_rows: int = 50_000    # the centroids are fitted on about so many vectors
    block: int = 1024            # members, or queries, of a block
    iterations: int = 10
    seed: int = 42


def directed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, unit) of the vectors that have a direction."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(
        "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0")
    return rows.select("id", "vec", F.transform("vec", lambda x: x / F.col("norm")).alias("unit"))


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class VectorIndex:
    """An index stored below ``path``; see the module's text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.id_type = dict(self.postings().dtypes)["ids"][len("array<"):-1]

    def postings(self) -> DataFrame:
        # an index without a member has no posting file to take the columns from
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, vec_col: str, path: str, p: IndexParams = IndexParams()) -> VectorIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        rows = shared_table(directed(vectors, id_col, vec_col), "index-vectors")
        n = rows.count()
        lists = max(1, min(p.max_lists, p.lists or round(n ** 0.5), n))
        part = -(-n // p.sample_rows) if n else 1
        sample = rows.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(part)) == 0).select(array_to_vector("unit").alias("features"))
        if n and not sample.isEmpty():
            model = KMeans(k=lists, maxIter=p.iterations, seed=p.seed, distanceMeasure="cosine").fit(sample)
            centres = np.array(model.clusterCenters(), dtype=np.float64)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        else:
            centres = np.zeros((1, 1))
        cls._place(spark, rows, centres, path.rstrip("/"), p)
        return cls(spark, path)

    @staticmethod
    def _place(spark, rows: DataFrame, centres: np.ndarray, path: str, p: IndexParams) -> None:
        """Assign every vector to its nearest centre and write the blocks and the lists."""
        import pandas as pd

        kind = dict(rows.dtypes)["id"]

        def nearest(batches):
            for pdf in batches:
                if len(pdf):
                    cos = _stack(pdf["unit"]) @ centres.T
                    best = cos.argmax(axis=1)
                    yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "list": best, "cos": cos[np.arange(len(best)), best]})

        assigned = shared_table(rows.mapInPandas(nearest, f"id {kind}, vec array<double>, list int, cos double"), "assigned")
        sizes = shared_table(assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("min_cos")), "list-sizes")
        # a member's block by its row, so that equal rows do not meet in one
        blocks = (assigned.withColumn("row", F.monotonically_increasing_id()).join(sizes.select("list", "n"), "list")
                  .withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / p.block)))
                  .groupBy("list", "block").agg(F.collect_list(F.struct("id", "vec")).alias("m")))
        postings = blocks.select(F.col("m.id").alias("ids"), F.col("m.vec").alias("vectors"), "list")
        spark.createDataFrame([], postings.schema).write.parquet(f"{path}/columns")
        postings.write.partitionBy("list").parquet(f"{path}/postings")
        centre_rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        centre_rows.join(sizes, "list").write.parquet(f"{path}/centroids")

    def _centres(self):
        rows = self.centroids().orderBy("list").collect()   # max_lists rows at most
        return (np.array([r["list"] for r in rows]), np.array([r["centre"] for r in rows]),
                np.array([r["min_cos"] for r in rows]))

    def _search(self, probes: DataFrame, k: int, block: int) -> DataFrame:
        """(qid, did, sim): the k best and more of the lists that ``probes`` (qid, vec, list) names."""
        import pandas as pd

        probes = shared_table(probes, "probes")
        kind = dict(probes.dtypes)["qid"]
        sizes = shared_table(probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "probe-sizes")
        asked = [r["list"] for r in sizes.select("list").collect()]   # max_lists rows at most
        queries = (probes.join(sizes, "list").withColumn("b", F.pmod(F.xxhash64("qid", "vec"), F.ceil(F.col("n") / block)))
                   .groupBy("list", "b").agg(F.collect_list(F.struct("qid", "vec")).alias("m"))
                   .select("list", F.col("m.qid").alias("qids"), F.col("m.vec").alias("qvecs")))
        pairs = self.postings().filter(F.col("list").isin(asked)).join(shared_table(queries, "query-blocks"), "list")

        def score(batches):
            for pdf in batches:
                for ids, vectors, qids, qvecs in zip(pdf["ids"], pdf["vectors"], pdf["qids"], pdf["qvecs"]):
                    x, q = np.stack(vectors), np.stack(qvecs)
                    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    keep = sims >= (np.partition(sims, -k, axis=1)[:, -k:-k + 1 or None] if sims.shape[1] > k else -2.0)
                    a, b = np.nonzero(keep)
                    yield pd.DataFrame({"qid": np.asarray(qids)[a], "did": np.asarray(ids)[b], "sim": sims[a, b]})

        return pairs.select("ids", "vectors", "qids", "qvecs").mapInPandas(score, f"qid {kind}, did {self.id_type}, sim double")

    def search(self, queries: DataFrame, qid: str, qvec: str, k: int = 10, probes: int | float = 16, exact: bool = False,
               block: int = 1024) -> DataFrame:
        """(qid, rank, did, sim): the k nearest members of each query by (cosine descending, id).

        ``probes`` lists are searched (a float: that share of all lists); with ``exact``, then also all others that can hold one of
        the k nearest."""
        import pandas as pd

        numbers, centres, min_cos = self._centres()
        q = shared_table(directed(queries, qid, qvec).withColumnRenamed("id", "qid"), "queries")
        kind = dict(q.dtypes)["qid"]
        if not len(numbers):
            return self.spark.createDataFrame([], f"qid {kind}, rank int, did {self.id_type}, sim double")
        count = min(probes if isinstance(probes, int) else int(np.ceil(probes * len(numbers))), len(numbers))

        def near(batches):
            for pdf in batches:
                if len(pdf):
                    cos = _stack(pdf["unit"]) @ centres.T
                    best = np.argpartition(-cos, count - 1, axis=1)[:, :count]
                    yield pd.DataFrame({"qid": pdf["qid"].repeat(count), "vec": pdf["vec"].repeat(count), "list": numbers[best].ravel()})

        schema = f"qid {kind}, vec array<double>, list int"
        ranked = lambda df: top_k(df, ["qid"], [F.col("sim").desc(), F.col("did")], k)
        columns = ["qid", "rank", "did", "sim"]
        first = ranked(self._search(q.mapInPandas(near, schema), k, block)).select(*columns)
        if not exact:
            return first
        first = shared_table(first, "first-hits")
        floors = first.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("sim"))).alias("floor"))
        angle = np.arccos(np.clip(min_cos, -1, 1))

        def rest(batches):
            for pdf in batches:
                if len(pdf):
                    cos = _stack(pdf["unit"]) @ centres.T
                    best = np.argpartition(-cos, count - 1, axis=1)[:, :count]
                    most = np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - angle, 0)) + 1e-7
                    wanted = most >= pdf["floor"].fillna(-2.0).to_numpy()[:, None]
                    wanted[np.arange(len(best))[:, None], best] = False   # searched before
                    a, b = np.nonzero(wanted)
                    yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[a], "vec": pdf["vec"].to_numpy()[a], "list": numbers[b]})

        more = q.join(floors, "qid", "left").select("qid", "vec", "unit", "floor").mapInPandas(rest, schema)
        return ranked(first.select("qid", "did", "sim").unionByName(self._search(more, k, block))).select(*columns)
