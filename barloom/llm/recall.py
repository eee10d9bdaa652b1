"""Recall of the neighbour search against a scan of all rows: ``python -m barloom.llm.recall FOLDER``."""

from __future__ import annotations

import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

from barloom.llm import nn_descent


def main(folder: str) -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "12", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{scratch}/shared", "spark.local.dir": f"{scratch}/local", "spark.sql.warehouse.dir": f"{scratch}/warehouse"}
    spark = SparkSession.builder.master("local[6]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    found = nn_descent.op5_nn_descent(spark, folder).toPandas()
    took = time.time() - began
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").filter("embedding is not null").toPandas()
    table = table[[len(v) == 64 and np.isfinite(v).all() and np.any(v) for v in table["embedding"]]]
    names, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = np.flatnonzero(names % 50 == 0)
    near = vectors[queries] @ vectors.T
    near[np.arange(len(queries)), queries] = -3
    fifth = -np.sort(-near, axis=1)[:, 4]
    least = dict(zip(names[queries].tolist(), fifth.tolist(), strict=True))
    hits = sum(s >= least[q] - 1e-12 for q, s in zip(found["query_id"], found["score"], strict=True))
    print(f"{len(names)} rows, {len(queries)} queries: recall {hits / (5 * len(queries)):.4f}, {found['visited'].mean():.0f} rows measured a query, {took:.0f} s")


if __name__ == "__main__":
    main(sys.argv[1])
