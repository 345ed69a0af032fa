"""How the constants of toxicity.py were chosen: cross-validation over rows that may teach, and no others.

python -m folioscope.llm.toxicity_choice SF_DIR... prints for each setting the mean log loss, and how many toxic and other rows of the
part left out are predicted toxic. The setting in use has the least log loss (the sum over sf0.01 and sf0.1) of those that flag at most
1.1 % of the other rows of either; a prototype of the same method outside Spark was used to find it.
"""

from __future__ import annotations

import itertools
import math
import os
import sys

GRID = {"prior": (5.0, 20.0), "sure": (3.0, 4.0, 5.0), "drift": (0.5, 1.0, 2.0)}


def main(folders: list[str], parts: int = 4) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from folioscope.llm import toxicity
    from folioscope.llm.common import table, written

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in folders:
        labels = table(spark, folder, "labels").where(~toxicity.held_out()).where("toxic is not null").select("doc_id", "toxic")
        docs = written(table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id"), "choice")
        part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts))
        for setting in itertools.product(*GRID.values()):
            got = []
            for k in range(parts):
                model = toxicity.fit(docs.select("doc_id", "text"), labels.where(part != k), **dict(zip(GRID, setting, strict=True)))
                got += toxicity.scored(docs.where(part == k), model).select("toxic", "score", "predicted").collect()
            loss = -sum(math.log(min(1 - 1e-4, max(1e-4, r.score if r.toxic else 1 - r.score))) for r in got) / max(1, len(got))
            hit, toxic, flagged = sum(r.toxic * r.predicted for r in got), sum(r.toxic for r in got), sum(r.predicted for r in got)
            print(os.path.basename(folder.rstrip("/")), dict(zip(GRID, setting, strict=True)), f"loss {loss:.4f} found {hit} of {toxic}, others flagged {flagged - hit} of {len(got) - toxic}, F1 {2 * hit / max(1, toxic + flagged):.3f}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
