"""A stored index of terms for BM25: postings sorted by term, and the length of every chunk.

A query reads the postings of its own terms only: the bucket of a term is a partition of the table, and within it the
rows are sorted by term, so filters on both reach the scan.  Text is not read again.  A term that stands in very many
chunks is grouped by chunk, which spreads it over all tasks.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import ParsedQuery
from fathomline.operators.search import B, K1, LEAST_IDF, WINDOW_WEIGHT, tokenised

BUCKETS = 32


class PostingIndex(NamedTuple):
    postings: DataFrame  # bucket, term, id, places
    lengths: DataFrame  # id, kind, dl


def bucket_of(term: str) -> int:
    """The bucket of a term, the same here and in the plan."""
    return int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16) % BUCKETS


def build_postings(chunks: DataFrame) -> PostingIndex:
    """The index of ``chunks`` (id, path, kind, content), to be written partitioned by bucket.

    Null ids are left out; chunks without tokens have a length of 0.
    """
    rows = tokenised(chunks.where("id is not null"))
    lengths = rows.select("id", "kind", F.size("toks").cast("long").alias("dl"))
    words = rows.select("id", F.posexplode("toks").alias("place", "term"))
    # the places of a term in a chunk are as many as the chunk has tokens at most
    listed = words.groupBy("term", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 7), 16, 10).cast("bigint"), F.lit(BUCKETS)).cast("int")
    # a hot term is split over several tasks of its bucket by the id
    placed = listed.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    return PostingIndex(placed.sortWithinPartitions("bucket", "term", "id"), lengths)


def write_postings(chunks: DataFrame, path: str) -> None:
    """Write the index of ``chunks`` below ``path``."""
    index = build_postings(chunks)
    index.lengths.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lengths")
    index.postings.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")


def read_postings(spark: SparkSession, path: str, key: str = "bigint") -> PostingIndex:
    postings = spark.read.schema(f"term string, id {key}, places array<int>, bucket int").parquet(f"{path}/postings")
    return PostingIndex(postings, spark.read.parquet(f"{path}/lengths"))


def bm25_stored(index: PostingIndex, query: ParsedQuery, k: int) -> DataFrame:
    """``id, score`` of the ``k`` best chunks, the same as ``search.bm25`` of the indexed chunks."""
    if not query.terms:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for t in query.terms for w in t})
    mine = index.postings.where(F.col("bucket").isin(sorted({bucket_of(w) for w in words})) & F.col("term").isin(words))
    by_chunk = mine.groupBy("id").agg(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"w{i}") for i, w in enumerate(words)])
    at = {w: F.coalesce(F.col(f"w{i}"), F.array().cast("array<int>")) for i, w in enumerate(words)}

    def count(term: list[str]):
        if len(term) == 1:
            return F.size(at[term[0]]).cast("long")
        follows = lambda p: F.aggregate(F.array(*[F.array_contains(at[w], p + i) for i, w in enumerate(term) if i]), F.lit(True), lambda a, x: a & x)
        return F.size(F.filter(at[term[0]], follows)).cast("long")

    counted = by_chunk.select("id", *[count(t).alias(f"tf{i}") for i, t in enumerate(query.terms)])
    every = range(len(query.terms))
    found = counted.agg(*[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in every])
    stats = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).crossJoin(found)  # one row each
    hit = [F.col(f"tf{i}") > 0 for i in every]
    wanted = hit[0]
    for h in hit[1:]:
        wanted = wanted & h if query.conjunctive else wanted | h
    part = lambda i: F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = sum((F.when(hit[i], part(i)).otherwise(0.0) for i in every), F.lit(0.0)) * F.when(F.col("kind") == "window", WINDOW_WEIGHT).otherwise(1.0)
    scored = counted.where(wanted).join(index.lengths, "id").crossJoin(F.broadcast(stats))
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
