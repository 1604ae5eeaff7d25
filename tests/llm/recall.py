"""python tests/llm/recall.py SF_DIR: recall of the 20 nearest and share of rows walked, by the index that the query fits."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import numpy as np
from pyspark.sql import SparkSession

from linkweave.llm import ann
from linkweave.llm.vectors import usable


def main(folder: str, every: int = 20, k: int = 20, recall: float = 0.94) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    rows = usable(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", nonzero=True)
    n = rows.count()
    index, share = ann.fit(rows, n, k, recall)
    got = rows.collect()
    ids, x = np.array([r["vec_id"] for r in got]), np.array([r["v"] for r in got])
    cell = index.cells(x)
    counts = np.bincount(cell, minlength=len(index.first) * len(index.second))
    shares, found = [], []
    for i in np.flatnonzero(ids % every == 0):
        walked = np.isin(cell, index.walk(x[i], counts, max(share * n, k + 1)))
        score = np.where(ids == ids[i], -np.inf, x @ x[i])
        true = ann.top(score, ids, min(k, n - 1))
        shares.append(walked.mean())
        found.append(walked[true].mean())
    print(f"{n} rows, {len(index.first)} x {len(index.second)} cells, {len(found)} queries: recall {np.mean(found):.4f}, {np.mean(shares):.3f} of the rows walked")


if __name__ == "__main__":
    main(sys.argv[1])
