"""A session over a pair of documents: stages are DataFrames that are computed once and reused by what they are made of."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import measures, policies


def fingerprint(**options) -> str:
    """Equal options have equal fingerprints: keys are sorted and absent ones dropped."""
    return hashlib.sha256(json.dumps({k: v for k, v in options.items() if v is not None}, sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """Persisted stages by name and fingerprint; dropping one drops what was made from it. A stage that fails isn't kept."""

    def __init__(self):
        self.kept: dict[tuple[str, str], DataFrame] = {}
        self.after: dict[str, set[str]] = {}

    def run(self, name: str, key: str, make: Callable[[], DataFrame], of: tuple[str, ...] = ()) -> DataFrame:
        for p in of:
            self.after.setdefault(p, set()).add(name)
        if (name, key) not in self.kept:
            self.kept[name, key] = make().persist()
        return self.kept[name, key]

    def drop(self, name: str) -> None:
        for n, key in [k for k in self.kept if k[0] == name]:
            self.kept.pop((n, key)).unpersist()
        for later in self.after.get(name, ()):
            self.drop(later)


class Comparison:
    """issued and returned: DataFrames of (doc_id, page, text), page texts as read. Every method returns a DataFrame; rows keep other columns of issued."""

    def __init__(self, issued: DataFrame, returned: DataFrame, min_text_score: float = 0.85):
        self.issued, self.returned, self.min_text_score = issued, returned, min_text_score
        self.stages = Stages()

    def pages(self) -> DataFrame:
        back = self.returned.select("doc_id", "page", F.col("text").alias("returned_text"))
        return self.stages.run("pages", "", lambda: self.issued.join(back, ["doc_id", "page"]))

    def unpaired(self) -> DataFrame:
        a, b = self.issued.select("doc_id", "page"), self.returned.select("doc_id", "page")
        return a.join(b, ["doc_id", "page"], "left_anti").withColumn("side", F.lit("issued")).unionByName(b.join(a, ["doc_id", "page"], "left_anti").withColumn("side", F.lit("returned")))

    def text(self, **options) -> DataFrame:
        def make():
            p = self.pages().withColumn("expected", T.normalise(F.col("text"), **options)).withColumn("actual", T.normalise(F.col("returned_text"), **options))
            return p.withColumn("metrics", T.compare_texts(F.col("expected"), F.col("actual")))

        return self.stages.run("text", fingerprint(**options), make, ("pages",))

    def audit(self) -> DataFrame:
        """A row per document: score by characters (1 for an empty one), pages to review, verdict."""
        p = self.text().select("doc_id", F.col("metrics.levenshtein_similarity").alias("score"), F.col("metrics.characters").alias("characters"))
        p = p.withColumn("verdict", policies.text_verdict(F.lit(0), F.col("score"), self.min_text_score))
        review = p.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "review").alias("review_pages"))
        g = measures.document_score(p, ["doc_id"], 1.0).join(review, "doc_id")
        return g.select("doc_id", "score", "pages", "review_pages", F.when(F.col("review_pages") > 0, "review").otherwise("pass").alias("verdict"))
