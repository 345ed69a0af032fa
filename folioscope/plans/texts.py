"""Text queries: normalisation, similarity of message pairs, scores of documents, content search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import search as S
from folioscope.functions import text as T
from folioscope.operators import measures as M
from folioscope.plans.registry import query
from folioscope.workers import ship

#: The accented letters of the driver's tables, for the oracles.
_FROM, _TO = "üöäèéÉêçÈñóíÇÑÖÊÄÜÓÍßáâîúÁÂÎÚàÀ", "uoaeeEecEnoiCNOEAUOIsaaiuAAIUaA"


def _norm(c: str) -> str:
    return f"lower(translate({c}, '{_FROM}', '{_TO}'))"


def _clean(c: str) -> str:
    """Lower case without accents; tokens with a letter or number; single blanks."""
    return f"array_to_string(list_filter(string_split_regex(trim(regexp_replace({_norm(c)}, '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '[a-z0-9$]')), ' ')"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean(c: str):
    """Normalised by the operator's defaults."""
    return T.normalise(F.col(c))


@query("normalise_text", f"SELECT doc_id, {_clean('text')} AS normalised FROM documents")
def normalise_text(spark, d):
    return read(spark, d, "documents").select("doc_id", clean("text").alias("normalised"))


@query("tokenise_count", f"SELECT lang, count(*) AS documents, sum(len(string_split(n, ' ')))::BIGINT AS words FROM (SELECT lang, {_clean('text')} AS n FROM documents) WHERE n <> '' GROUP BY lang")
def tokenise_count(spark, d):
    n = read(spark, d, "documents").select("lang", clean("text").alias("n")).where("n <> ''")
    return n.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size(T.tokens(F.col("n")))).cast("long").alias("words"))


@query("fold_diacritics", f"SELECT doc_id, translate(text, '{_FROM}', '{_TO}') AS folded FROM documents")
def fold_diacritics(spark, d):
    return read(spark, d, "documents").select("doc_id", T.fold_diacritics(F.col("text")).alias("folded"))


@query("fold_confusables", "SELECT doc_id, translate(replace(replace(replace(lower(text), 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '01i|!5862', 'ollllsbbz') AS folded FROM documents")
def fold_confusables(spark, d):
    return read(spark, d, "documents").select("doc_id", T.fold_confusables(F.lower("text")).alias("folded"))


@query("utf16_length", "SELECT doc_id, length(text)::INTEGER AS units FROM documents")
def utf16_units(spark, d):
    return read(spark, d, "documents").select("doc_id", T.utf16_length(F.col("text")).alias("units"))


_PAIRS = f"""pairs AS (SELECT a.conv_id, a.turn, {_clean('a.text')} AS x, {_clean('b.text')} AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
bags AS (SELECT conv_id, turn, w, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM (
  SELECT conv_id, turn, 0 AS side, unnest(string_split(x, ' ')) AS w FROM pairs UNION ALL SELECT conv_id, turn, 1, unnest(string_split(y, ' ')) FROM pairs) WHERE w <> '' GROUP BY ALL)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each message and the next of its conversation, normalised."""
    c = read(spark, d, "conversations").select("conv_id", "turn", clean("text").alias("t"))
    return c.withColumnRenamed("t", "x").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("y")), ["conv_id", "turn"])


def bags(p: DataFrame) -> DataFrame:
    """Token counts of both sides of each pair: grouped, so that long texts aren't quadratic."""
    side = lambda c, s: p.select("conv_id", "turn", F.lit(s).alias("s"), F.explode(T.tokens(F.col(c))).alias("w"))
    return side("x", 0).unionByName(side("y", 1)).groupBy("conv_id", "turn", "w").agg(F.count_if(F.col("s") == 0).alias("ca"), F.count_if(F.col("s") == 1).alias("cb"))


def r6(c):
    return F.round(c, 6)


@query("levenshtein_similarity", f"WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END, 6) AS similarity FROM pairs")
def levenshtein_similarity(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(T.levenshtein_similarity(F.col("x"), F.col("y"))).alias("similarity"))


@query("char_error_rate", f"WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN length(x) = 0 THEN (CASE WHEN length(y) = 0 THEN 0.0 ELSE 1.0 END) ELSE levenshtein(x, y)::DOUBLE / length(x) END, 6) AS rate FROM pairs")
def char_error_rate(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(T.error_rate(F.col("x"), F.col("y"))).alias("rate"))


@query("jaccard_words", f"WITH {_PAIRS} SELECT conv_id, turn, round(count(*) FILTER (ca > 0 AND cb > 0)::DOUBLE / count(*), 6) AS jaccard FROM bags GROUP BY ALL")
def jaccard_words(spark, d):
    p = pairs(spark, d).where("x <> '' or y <> ''")
    return p.select("conv_id", "turn", r6(T.jaccard(T.tokens(F.col("x")), T.tokens(F.col("y")))).alias("jaccard"))


@query("word_recall", f"WITH {_PAIRS} SELECT conv_id, turn, round(sum(least(ca, cb))::DOUBLE / sum(ca), 6) AS recall FROM bags GROUP BY ALL HAVING sum(ca) > 0")
def word_recall(spark, d):
    return bags(pairs(spark, d)).groupBy("conv_id", "turn").agg(F.sum(F.least("ca", "cb")).alias("l"), F.sum("ca").alias("a")).where("a > 0").select("conv_id", "turn", r6(F.col("l") / F.col("a")).alias("recall"))


@query("cosine_words", f"WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN sum(ca) = 0 OR sum(cb) = 0 THEN 0.0 ELSE sum(ca * cb)::DOUBLE / sqrt(sum(ca * ca)::DOUBLE * sum(cb * cb)::DOUBLE) END, 6) AS cosine FROM bags GROUP BY ALL")
def cosine_words(spark, d):
    g = bags(pairs(spark, d)).groupBy("conv_id", "turn").agg(F.sum(F.col("ca") * F.col("cb")).alias("ab"), F.sum(F.col("ca") * F.col("ca")).alias("aa"), F.sum(F.col("cb") * F.col("cb")).alias("bb"))
    return g.select("conv_id", "turn", r6(F.when((F.col("aa") == 0) | (F.col("bb") == 0), F.lit(0.0)).otherwise(F.col("ab") / F.sqrt(F.col("aa").cast("double") * F.col("bb")))).alias("cosine"))


@query(
    "dice_bigrams",
    f"""WITH {_PAIRS}, grams AS (SELECT conv_id, turn, g, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM (
  SELECT conv_id, turn, 0 AS side, substring(x, i::INT, 2) AS g FROM (SELECT *, unnest(range(1, length(x))) AS i FROM pairs)
  UNION ALL SELECT conv_id, turn, 1, substring(y, i::INT, 2) FROM (SELECT *, unnest(range(1, length(y))) AS i FROM pairs)) GROUP BY ALL)
SELECT conv_id, turn, round(2.0 * sum(least(ca, cb)) / sum(ca + cb), 6) AS dice FROM grams GROUP BY ALL""",
)
def dice_bigrams(spark, d):
    p = pairs(spark, d)
    side = lambda c, s: p.select("conv_id", "turn", F.lit(s).alias("s"), F.explode(T.bigrams(F.col(c))).alias("g"))
    g = side("x", 0).unionByName(side("y", 1)).groupBy("conv_id", "turn", "g").agg(F.count_if(F.col("s") == 0).alias("ca"), F.count_if(F.col("s") == 1).alias("cb"))
    return g.groupBy("conv_id", "turn").agg(r6(2 * F.sum(F.least("ca", "cb")) / F.sum(F.col("ca") + F.col("cb"))).alias("dice"))


@query("jaro_winkler")
def jaro_winkler(spark, d):
    return pairs(spark, d).select("conv_id", "turn", r6(T.jaro_winkler("x", "y")).alias("jaro_winkler"))


@query("compare_texts")
def compare_texts(spark, d):
    p = pairs(spark, d).withColumn("m", T.compare_texts(F.col("x"), F.col("y")))
    return p.select("conv_id", "turn", *(r6(F.col(f"m.{f}")).alias(f) for f in ("levenshtein_similarity", "jaccard", "dice", "cosine", "jaro_winkler", "character_error_rate", "word_error_rate", "word_recall", "length_ratio")), "m.levenshtein", "m.characters")


_SCORES = f"""WITH {_PAIRS}, scores AS (SELECT conv_id, turn, length(x) AS chars, CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS score FROM pairs)"""


def scores(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.length("x").cast("long").alias("chars"), T.levenshtein_similarity(F.col("x"), F.col("y")).alias("score"))


@query("document_score_weighted", _SCORES + " SELECT conv_id, round(CASE WHEN sum(chars) = 0 THEN avg(score) ELSE sum(score * chars) / sum(chars) END, 6) AS score, count(*) AS pages FROM scores GROUP BY conv_id")
def document_score_weighted(spark, d):
    """Mean of page scores by characters, the plain mean of pages without any."""
    s = M.document_score(scores(spark, d).withColumnRenamed("chars", "characters"), ["conv_id"])
    return s.select("conv_id", r6(F.col("score")).alias("score"), "pages")


@query("document_rollup", _SCORES + " SELECT conv_id, turn, count(*) AS pages, sum(chars)::BIGINT AS characters FROM scores GROUP BY ROLLUP (conv_id, turn)")
def document_rollup(spark, d):
    return scores(spark, d).rollup("conv_id", "turn").agg(F.count("*").alias("pages"), F.sum("chars").alias("characters"))


@query(
    "judge_run",
    f"""WITH {_PAIRS}, j AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS dx, regexp_replace(y, '[^0-9]', '', 'g') AS dy FROM pairs)
SELECT conv_id, turn, CASE WHEN x = '' THEN 'agrees' WHEN y = '' THEN 'missing' WHEN dx <> dy THEN 'numbers' WHEN regexp_full_match(x, '[^a-z]*[0-9][^a-z]*') THEN 'agrees'
  WHEN 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) < 0.8 THEN 'text' ELSE 'agrees' END AS verdict FROM j""",
)
def judge_run(spark, d):
    """Digits before similarity; a pure figure with equal digits agrees."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    verdict = (
        F.when(F.col("x") == "", "agrees")
        .when(F.col("y") == "", "missing")
        .when(digits("x") != digits("y"), "numbers")
        .when(F.col("x").rlike("^[^a-z]*[0-9][^a-z]*$"), "agrees")
        .when(T.levenshtein_similarity(F.col("x"), F.col("y")) < 0.8, "text")
        .otherwise("agrees")
    )
    return pairs(spark, d).select("conv_id", "turn", verdict.alias("verdict"))


@query("find_content_exact", f"SELECT item_id, count(*) AS found_in, min(doc_id) AS first_doc FROM (SELECT item_id, {_clean('text')} AS needle FROM benchmark) b JOIN (SELECT doc_id, {_clean('text')} AS hay FROM documents) d ON contains(hay, needle) GROUP BY item_id")
def find_content_exact(spark, d):
    """Needles found in pages as they are."""
    needles = read(spark, d, "benchmark").select("item_id", clean("text").alias("needle"))
    pages = read(spark, d, "documents").select("doc_id", clean("text").alias("hay"))
    return S.contained(pages, needles, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("found_in"), F.min("doc_id").alias("first_doc"))


@query("approximate_search")
def approximate_search(spark, d):
    """Each whole line of a message looked for in the whole next message, with edits: all places, the best first, offsets in its normalised text."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).select("conv_id", "turn", "line", clean("text").alias("needle")).where("needle <> ''")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), clean("text").alias("y"))
    p = lines.join(after, ["conv_id", "turn"]).withColumn("places", S.search_column("needle", "y", 0.7))
    return p.select("conv_id", "turn", "line", "needle", F.size("places").alias("n_places"), F.get("places", 0)["distance"].alias("first_distance"), "places")


@query("bag_frequencies", f"SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(string_split({_clean('text')}, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def bag_frequencies(spark, d):
    return read(spark, d, "documents").select("lang", F.explode(T.tokens(clean("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("option_fingerprint", "SELECT p_partkey, sha256(p_brand || '|' || p_size || '|' || p_type) AS fingerprint FROM part")
def option_fingerprint(spark, d):
    return read(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_size", "p_type"), 256).alias("fingerprint"))


@query("edge_punctuation", "SELECT conv_id, turn, '[' || array_to_string(list_transform(string_split_regex(trim(text), '\\s+'), lambda x: regexp_replace(regexp_replace(x, '^[[:punct:]]+', ''), '[[:punct:]]+$', '')), ', ') || ']' AS keys FROM (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ,.\n]', '', 'g') AS text FROM conversations)")
def edge_punctuation(spark, d):
    t = F.regexp_replace("text", "[^A-Za-z ,.\n]", "")
    keys = F.transform(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+"), T.edge_trimmed)
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"))


