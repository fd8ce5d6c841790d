"""Semantic text search: an inverted index of hashed terms, joined under bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_dir

# Buckets that terms are hashed into, and a query's rarest terms that set the first bound.
BUCKETS, SEED = 1 << 20, 3
WORD = r"\p{L}+"
EPSILON = 1e-12


def term_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word of a text, repeats included; a word is a run of letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast(
        "long") % buckets)


def postings(texts: DataFrame, key: str = "id", text: str = "text", buckets: int = BUCKETS
             ) -> DataFrame:
    """(bucket, key, tf, norm2): how often a text has each bucket, and its squared length.

    Counted within the row: sorted buckets, and where each run of equal ones begins.  A text that
    is null or has no letters has no rows.
    """
    # One row each: a generated column is worked out once, where a projected one would be
    # put into every lambda that reads it.
    listed = texts.select(key, F.explode(F.array(F.sort_array(
        term_buckets(F.col(text), buckets)))).alias("b")).where(F.size("b") > 0)
    runs = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: (i == 0) | (
        F.get("b", i) != F.get("b", i - 1)))
    counted = listed.withColumn("starts", runs).select(
        key, F.zip_with(
            "starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("b"))),
            lambda i, j: F.struct(F.get("b", i).alias("bucket"), (j - i).cast("long").alias("tf"))
        ).alias("terms"))
    norm2 = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t["tf"] * t["tf"])
    # There is always a term.  For a plain inline Spark would ask first, and count twice.
    return counted.withColumn("norm2", norm2).select(key, "norm2", F.inline_outer("terms")).select(
        "bucket", key, "tf", "norm2")


def build_index(texts: DataFrame, key: str = "id", text: str = "text", buckets: int = BUCKETS,
                store: str | None = None) -> DataFrame:
    """The postings of all texts, written once to ``store`` (none: the scratch folder)."""
    return _written(postings(texts, key, text, buckets), "postings", store)


def _written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` from files in the shared folder: what is read several times is worked out once."""
    path = path or scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _score(dot: Column, left: Column, right: Column) -> Column:
    return dot.cast("double") / F.sqrt(left.cast("double") * right.cast("double"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id, score, rank): the k texts of largest cosine for each ``(query_id, text)``.

    Exact, without scoring every text that shares a common word.  A term adds at most the query's
    weight times the largest weight in its postings.  The rarest terms of a query give a lower
    bound of the k-th score; terms whose bounds, with those of all more common ones,
    stay below it cannot bring a text in by themselves.  Texts found by the others are
    candidates; those that their missing terms cannot lift to the bound go, and only the
    rest meet the common terms' postings.  Ties go to the smaller id.  A query without a word of
    the index finds nothing.
    """
    asked = postings(queries, "query_id", "text", buckets).select(
        "query_id", "bucket", F.col("tf").alias("qtf"), F.col("norm2").alias("qn"))
    weight = F.col("tf") / F.sqrt(F.col("norm2").cast("double"))
    bounds = index.join(asked.select("bucket").distinct(), "bucket", "left_semi").groupBy(
        "bucket").agg(F.max(weight).alias("most"), F.count(F.lit(1)).alias("df"))
    rare_first = W.partitionBy("query_id").orderBy("df", "bucket")
    terms = asked.join(bounds, "bucket").withColumn(
        "most", F.col("qtf") / F.sqrt(F.col("qn").cast("double")) * F.col("most")
    ).withColumn("turn", F.row_number().over(rare_first)).withColumn(
        "rest", F.sum("most").over(rare_first.rowsBetween(0, W.unboundedFollowing)))

    terms = _written(terms, "query-terms")

    def met(wanted: DataFrame) -> DataFrame:
        return wanted.join(index, "bucket").groupBy("query_id", "id").agg(
            F.sum(F.col("qtf") * F.col("tf")).alias("dot"), F.first("qn").alias("qn"),
            F.first("norm2").alias("norm2"))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    score = _score(F.col("dot"), F.col("qn"), F.col("norm2"))
    least = met(terms.where(F.col("turn") <= SEED)).withColumn("score", score).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(
        F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    bounded = terms.join(least, "query_id", "left").withColumn(
        "least", F.coalesce("least", F.lit(0.0)) - EPSILON)
    bounded = _written(bounded, "bounded-terms")
    essential = bounded.where(F.col("rest") >= F.col("least"))
    common = bounded.where(F.col("rest") < F.col("least"))
    left_out = common.groupBy("query_id").agg(
        F.max("rest").alias("rest"), F.first("least").alias("least"))
    candidates = met(essential).join(left_out, "query_id", "left").where(
        F.col("rest").isNull() | (score + F.col("rest") >= F.col("least"))
    ).select("query_id", "id", "dot", "qn", "norm2")
    candidates = _written(candidates, "candidates")
    more = candidates.select("query_id", "id", "qn", "norm2").join(
        common.select("query_id", "bucket", "qtf"), "query_id").join(
        index.select("bucket", "id", "tf"), ["bucket", "id"]).select(
        "query_id", "id", (F.col("qtf") * F.col("tf")).alias("dot"), "qn", "norm2")
    whole = candidates.unionByName(more).groupBy("query_id", "id", "qn", "norm2").agg(
        F.sum("dot").alias("dot"))
    return whole.select("query_id", "id", score.alias("score")).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k)
