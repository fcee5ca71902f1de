"""Document fingerprints: Merkle trees over paragraphs and sections, with DataFrame functions only.

Levels: root, sections (SECTION paragraphs), paragraphs (lines), leaves (runs of words). A leaf ends after a word,
not an empty one, whose hash is 0 modulo LEAF_WORDS, or after MOST_WORDS words of its paragraph, so an edit moves no other leaf's
ends beyond the next such word. A node's hash is the SHA-256 of its children's; a leaf's that of its text; the root also
covers the whole text. So equal roots mean equal texts, and a differing section or paragraph tells where an edit is.

A fingerprint is text: 32 hex digits of the root, then sections set off by `/`, paragraphs by `.`, and 8 hex digits
for each leaf; behind `|` the inner nodes, for each section its hash and those of its paragraphs, 8 hex digits each.
likeness() is the Dice coefficient of two fingerprints' sets of leaves. differing() descends from the root: equal roots
end it, equal sections are skipped by their hash, and of differing ones the paragraphs' hashes are compared; two nodes
that differ have the same 8 digits with a chance of 2 to the -32.

Next documents: rows are cut into buckets by quantiles of the id, which are ids themselves, so each bucket's first
row is known and is sent to the bucket before as well. Each bucket is sorted by itself; no window spans the table.

Defined results: a null text counts as empty; a null id comes first; rows that share an id stand in order of their
text; of equal rows each has the other as next; a single row is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_WORDS, MOST_WORDS, SECTION, DIGITS = 4, 16, 8, 8
_CUT = "\x1e"


def _paragraph(line: Column) -> Column:
    """struct<hash, leaves> of one line; leaves: DIGITS hex digits each, joined."""
    ends = lambda w, i: ((w != "") & (F.pmod(F.xxhash64(w), F.lit(LEAF_WORDS)) == 0)) | (i % MOST_WORDS == MOST_WORDS - 1)
    marked = F.array_join(F.transform(F.split(line, " "), lambda w, i: F.concat(w, F.when(ends(w, i), F.lit(_CUT)).otherwise(F.lit(" ")))), "")
    whole = F.transform(F.array(marked), lambda m: F.left(m, F.length(m) - 1))[0]  # without the mark after the last word
    hashes = F.transform(F.split(whole, _CUT), lambda leaf: F.sha2(leaf, 256))
    return F.struct(
        F.sha2(F.array_join(hashes, ""), 256).alias("hash"),
        F.array_join(F.transform(hashes, lambda h: F.left(h, F.lit(DIGITS))), "").alias("leaves"),
    )


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text without nulls."""
    # U+001E is the mark of a leaf's end, so a text's own are written otherwise
    plain = F.replace(F.replace(text, F.lit("\x1d"), F.lit("\x1d0")), F.lit(_CUT), F.lit("\x1d1"))
    paragraphs = F.transform(F.split(plain, "\n"), _paragraph)

    def tree(ps: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: i % SECTION == 1)
        sections = F.transform(firsts, lambda i: F.slice(ps, i, SECTION))
        nodes = F.transform(
            sections,
            lambda s: F.struct(
                F.sha2(F.array_join(F.transform(s, lambda p: p["hash"]), ""), 256).alias("hash"),
                F.array_join(F.transform(s, lambda p: p["leaves"]), ".").alias("leaves"),
                F.array_join(F.transform(s, lambda p: F.left(p["hash"], F.lit(DIGITS))), "").alias("inner"),
            ),
        )
        # one pass over nodes: the root, leaves, inner nodes
        return F.transform(
            F.array(nodes),
            lambda n: F.concat(
                F.left(
                    F.sha2(F.concat(F.array_join(F.transform(n, lambda x: x["hash"]), ""), F.sha2(text, 256)), 256), F.lit(32),
                ),
                F.lit(":"), F.array_join(F.transform(n, lambda x: x["leaves"]), "/"), F.lit("|"),
                F.array_join(F.transform(n, lambda x: F.concat(F.left(x["hash"], F.lit(DIGITS)), x["inner"])), "/"),
            ),
        )[0]

    return F.transform(F.array(paragraphs), tree)[0]


def leaves(fp: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring(F.substring_index(fp, "|", 1), 34, 1 << 30), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the shared leaves over all leaves; 1 for equal roots."""

    def dice(x: Column, y: Column) -> Column:
        return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))

    pair = F.array(F.struct(leaves(a).alias("a"), leaves(b).alias("b")))
    return F.when(F.left(a, F.lit(32)) == F.left(b, F.lit(32)), 1.0).otherwise(F.transform(pair, lambda p: dice(p["a"], p["b"]))[0])


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0) of the paragraphs in which two fingerprints differ, found by descent."""
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    sections = lambda fp: F.split(F.substring_index(fp, "|", -1), "/")
    children = lambda node: F.regexp_extract_all(
        F.substring(F.coalesce(node, F.lit("")), DIGITS + 1, 1 << 30), F.lit(f".{{{DIGITS}}}"), F.lit(0),
    )

    def inside(s: Column, x: Column, y: Column) -> Column:
        paragraphs = F.zip_with(children(x), children(y), lambda p, q: ~p.eqNullSafe(q))
        places = F.transform(paragraphs, lambda d, i: F.struct(s.alias("section"), i.alias("paragraph"), d.alias("differs")))
        return F.transform(
            F.filter(places, lambda p: p["differs"]),
            lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")),
        )

    pairs = F.zip_with(sections(a), sections(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    same = lambda p: F.left(p["x"], F.lit(DIGITS)).eqNullSafe(F.left(p["y"], F.lit(DIGITS)))
    found = F.flatten(F.transform(pairs, lambda p, s: F.when(same(p), none).otherwise(inside(s, p["x"], p["y"]))))
    return F.when(F.left(a, F.lit(32)) == F.left(b, F.lit(32)), none).otherwise(found)


def with_next(rows: DataFrame, columns: tuple[str, ...], buckets: int, id_col: str = "doc_id") -> DataFrame:
    """rows, and next_<column> of the row that follows in order of the id (after the last: the first)."""
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long"))
    share = [k / buckets for k in range(1, buckets)]
    found = rows.select(key.alias("k")).agg(
        F.min("k").alias("lo"),
        F.percentile_approx(
            "k", F.array(*map(F.lit, share)), max(10_000, 20 * buckets),
        ).alias("cuts") if share else F.array().alias("cuts"),
    ).first()
    if found["lo"] is None:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted({found["lo"], *(found["cuts"] or [])})  # ids that exist: each bucket's first
    steps = max(1, (len(bounds) - 1).bit_length())
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    # binary search: the last bound that isn't above the key
    down = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    bucket = F.aggregate(down, F.lit(0), lambda i, step: F.when((i + step < len(bounds)) & (F.get(at, i + step) <= key), i + step).otherwise(i))
    keyed = rows.withColumn("_key", key).withColumn("_bucket", bucket)
    first = F.get(at, F.col("_bucket")) == F.col("_key")
    before = F.when(F.col("_bucket") == 0, len(bounds) - 1).otherwise(F.col("_bucket") - 1)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    both = keyed.withColumn(
        "_at",
        F.explode(
            F.when(first, F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
        ),
    )
    order = Window.partitionBy("_at.bucket").orderBy("_at.guest", "_key", "text")
    ahead = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_at.guest"))
    return ahead.drop("_key", "_bucket", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint) of each row."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.select("doc_id", "text", fingerprint(F.col("text")).alias("fingerprint"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document against its edited text and the next document."""
    printed = fingerprints(docs)
    buckets = max(1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ahead = with_next(printed, ("text", "fingerprint"), buckets)
    n = F.char_length("text")
    take = F.floor(n / 4).cast("int")
    edited = ahead.select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - take), F.left("next_text", take)).alias("edited"),
        "fingerprint", "next_fingerprint",
    )
    both = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"),
    )
