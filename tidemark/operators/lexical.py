"""Lexical retrieval: an inverted index with IDF and length normalisation, and exact top k without reading every common word.

An index is two tables: postings (term, doc_id, part), a file's documents by term, where part is what the term's count and
the document's length say (BM25), and terms (term, df, idf, most), where most is the greatest impact, idf * part, of the term anywhere.

A search is exact and goes in three steps. The terms of a query with the greatest impacts lead to some documents; the k-th
of these documents' scores is a bound that the result can't fall below. Terms are then left aside, those of least impact first, as
long as their greatest impacts together stay below a share of the bound: a document that has none but such terms can't be among the k.
Documents with any other term are candidates if these terms' impacts and all that was left aside reach the bound, and only
candidates meet the terms left aside. So the postings of common words are met by candidates, not by queries.

Defined results: a null or empty text has no words, and isn't found; a null id is an id like others in no search, so such rows are
left out; rows that share an id count as one document; words are runs of a-z and 0-9 after A-Z are lower-cased; a query
without known words has no results; fewer documents than k with any of the words: so many results.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

#: Saturation of counts, and weight of lengths.
K1, B = 1.2, 0.75
#: Documents that the first step aims at, for each of k.
FIRST = 8
#: Share of the bound that terms left aside may reach together: with less, more postings are summed and fewer documents are candidates.
ASIDE = 0.2
#: Scores are equal if they differ by less.
MARGIN = 1e-5


def words(text: Column) -> Column:
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(small, F.lit("[a-z0-9]+"), F.lit(0))


@dataclass(frozen=True)
class LexicalIndex:
    """An index in a folder."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> LexicalIndex:
        """Texts are shuffled by id, once; their words are counted, sorted and written where they arrive."""
        own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
        n, length = own.agg(F.count_distinct("doc_id"), F.sum(F.size(words(F.col("text"))))).first()
        counts = own.repartition("doc_id").select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        lengths = F.sum("tf").over(Window.partitionBy("doc_id"))
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * lengths / F.lit(length / n if length else 1.0))
        parts = counts.select("term", "doc_id", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))
        parts.sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
        index = cls(docs.sparkSession, folder)
        dfs = index.postings().groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("part"))
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        dfs.select("term", "df", idf.alias("idf"), (idf * F.col("part")).alias("most")).write.parquet(f"{folder}/terms")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/terms")

    def asked(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """(query_id, term, df, idf, most) of each query's known words."""
        own = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
        return own.join(self.terms(), "term")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
        """(query_id, rank, doc_id, score): the k best documents of each query, ties by id; exact."""
        # tables that meet the postings are written first, so that Spark knows how small they are and leaves the postings in place
        asked = written(self.asked(queries, query_id, text), "asked")
        best = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
        reached = F.coalesce(F.sum("df").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = asked.withColumn("reached", reached).filter(F.col("reached") < FIRST * k).select("query_id", "term", "idf")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        tried = self._summed(first).withColumn("place", place).filter(F.col("place") <= FIRST * k).select("query_id", "doc_id")
        whole = self._summed(written(tried.join(asked.select("query_id", "term", "idf"), "query_id"), "tried"))
        bounds = whole.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("bound"))
        least = Window.partitionBy("query_id").orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
        below = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - MARGIN)
        parted = written(below.withColumn("aside", F.sum("most").over(least) < ASIDE * F.col("bound")), "parted")
        aside = parted.filter("aside").select("query_id", "term", "idf")
        limits = parted.groupBy("query_id").agg((F.first("bound") - F.sum(F.when(F.col("aside"), F.col("most")).otherwise(0.0))).alias("least"))
        reach = self._summed(parted.filter("not aside").select("query_id", "term", "idf")).withColumnRenamed("score", "known")
        candidates = written(reach.join(limits, "query_id").filter("known >= least").drop("least"), "candidates")
        more = self._summed(written(candidates.select("query_id", "doc_id").join(aside, "query_id"), "open"))
        scores = candidates.join(more, ["query_id", "doc_id"], "left").withColumn("score", F.col("known") + F.coalesce("score", F.lit(0.0)))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 5)), "doc_id")
        ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "doc_id", "score")

    def _summed(self, wanted: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) over the postings of wanted (query_id, term, idf), or of wanted documents (and doc_id) alone."""
        own = self.postings().join(wanted, [c for c in ("term", "doc_id") if c in wanted.columns])
        return own.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"))
