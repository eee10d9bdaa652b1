"""What scoring leaves on disk."""

from pathlib import Path

import numpy as np

from barloom.llm import lm_score
from barloom.llm.shared import shared_dir


def size(path) -> int:
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_tables_are_no_larger_than_the_limit(spark, tmp_path):
    """All tables that a run leaves, every context having its restaurant, take less than 4 times its input."""
    rng = np.random.default_rng(0)
    draws = np.minimum(rng.zipf(1.25, (400, 500)), 10**7)
    spark.createDataFrame([(i, " ".join(f"w{w:x}" for w in x)) for i, x in enumerate(draws.tolist())], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    before = size(shared_dir(spark)) if Path(shared_dir(spark)).exists() else 0
    rows = lm_score.score_texts(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert len(rows) == 400 and all(r["n_tokens"] == 501 and np.isfinite(r["score"]) for r in rows)
    assert size(shared_dir(spark)) - before < 4 * size(tmp_path / "docs")
