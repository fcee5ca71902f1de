"""Names matched with a catalog of any size by bigrams: a join that finds what comparing all with all would.

The likeness is the matching-blocks ratio, 2 * M / (length + length), where M characters match in order. A ratio of t or more
leaves at least (1.5 t - 1) * (length + length) + 1 common bigrams of the padded names, as a character of one name that is
unmatched breaks two of its bigrams at most, and one of the other name a single one; and the shorter name has at least
t / (2 - t) of the longer one's length. So two such names share one of their rarest bigrams (all but as many as they have to
share, less one), which is the join; lengths and common bigrams are then counted, and only what is left is compared.

Defined results: case is ignored, a null name is an empty one, and an empty one matches an empty one; repeated names and
catalog rows count once; of catalog names that are equally alike the last in code-point order is taken; without any, null.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def bigrams(name: Column) -> Column:
    """Bigrams of a name with its ends, each with its number among equal ones, so sets compare as bags."""
    padded = F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def _rare_first(rows: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """(name, size, grams, gram) with a row for each of a name's rarest bigrams that a match has to meet."""
    each = rows.select("name", F.explode("grams").alias("gram")).join(seen, "gram", "left")
    order = each.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("sorted"))
    size = F.length("name")
    shared = F.ceil(F.lit(1.5 * least - 1) * (size + size * (least / (2 - least))) + 1 - 1e-9)  # with the shortest partner
    first = F.slice("sorted", F.lit(1), F.greatest(F.lit(0), F.size("sorted") - shared + 1).cast("int"))
    return order.select("name", F.transform("sorted", lambda s: s["gram"]).alias("grams"), F.explode(F.transform(first, lambda s: s["gram"])).alias("gram"))


def candidates(names: DataFrame, catalog: DataFrame, least: float) -> DataFrame:
    """(name, other): the pairs that can be alike; both tables have distinct lower-case (name, grams)."""
    seen = catalog.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    left = _rare_first(names, seen, least)
    right = _rare_first(catalog, seen, least).withColumnsRenamed({"name": "other", "grams": "other_grams"})
    a, b = F.length("name"), F.length("other")
    near = F.least(a, b) * (2 - least) >= F.greatest(a, b) * least - 1e-9
    both = left.join(right, "gram").filter(near)
    common = F.array_intersect("grams", "other_grams")
    # a pair counts where its first common rarest bigram is
    enough = both.filter(F.size(common) >= F.lit(1.5 * least - 1) * (a + b) + 1 - 1e-9)
    return enough.select("name", "other").distinct()


def closest(names: DataFrame, catalog: DataFrame, column: str, name: str, least: float = 0.8) -> DataFrame:
    """(column, match): each distinct value of names[column] with the most alike of catalog[name], at a ratio of least or more.

    least has to be above 2 / 3, where alike names always share a bigram.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least has to be above 2/3 and at most 1")
    asked = names.select(F.col(column).cast("string").alias("asked")).distinct().withColumn("name", F.lower(F.coalesce("asked", F.lit(""))))
    known = catalog.select(F.col(name).cast("string").alias("known")).filter("known is not null").distinct().withColumn("other", F.lower("known"))
    grams = lambda rows, c: written(rows.select(F.col(c).alias("name")).distinct().withColumn("grams", bigrams(F.col("name"))), "names")
    pairs = candidates(grams(asked, "name"), grams(known, "other"), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratio, pa.float64())], names=["name", "other", "ratio"])

    alike = pairs.mapInArrow(run, "name string, other string, ratio double").filter(F.col("ratio") >= least)
    # names of the catalog that differ in case are equally alike
    best = alike.join(known.groupBy("other").agg(F.max("known").alias("known")), "other").groupBy("name").agg(F.max(F.struct("ratio", "known"))["known"].alias("match"))
    return asked.join(best, "name", "left").select(F.col("asked").alias(column), "match")
