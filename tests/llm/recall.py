"""Recall of op3 against brute force: python tests/llm/recall.py FOLDER..."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))
from palimpsest.llm.tree import op3_kmeans_tree_neighbours

NEAREST, STRIDE = 20, 20


def recall(spark: SparkSession, folder: str) -> float:
    """Mean share of a query's nearest that are found. Queries are held against all rows in blocks; ties go to smaller ids."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    good = [v is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v) for v in rows["embedding"]]
    ids, vectors = rows["vec_id"][good].to_numpy(), np.array(rows["embedding"][good].tolist(), float)
    found = op3_kmeans_tree_neighbours(spark, folder).toPandas().groupby("query_id")["vec_id"].apply(set)
    shares = []
    asked = np.flatnonzero(ids % STRIDE == 0)
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        scores = vectors[some] @ vectors.T
        scores[np.arange(len(some)), some] = -np.inf
        for i, row in zip(some, scores, strict=True):
            best = ids[np.argsort(-row, kind="stable")[:NEAREST]]
            shares.append(len(found.get(ids[i], set()) & set(best.tolist())) / len(best))
    return float(np.mean(shares))


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    for folder in sys.argv[1:]:
        print(folder, round(recall(spark, folder), 4), flush=True)
    spark.stop()
