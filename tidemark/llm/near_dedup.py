"""Near-duplicate groups by bottom-k sketches of one hash function.

1. Each text's shingle set is hashed; the SKETCH smallest hashes are retained. Texts with equal sets are one node, named
   by 16 bytes of the set's digest, so rows that share an id but not a text are nodes of their own.
2. Inverted lists of retained values: two sets with Jaccard 0.75 share at least OVERLAP of SKETCH retained values but
   for a chance of about 4e-5 at the threshold itself, and less above. In order of rarity, such sets share one of
   their first m - t + 1 values (m retained, t = m * OVERLAP / SKETCH), so only those enter lists, and values that one
   node alone retains drop out. No list, partner or candidate is capped.
3. Stars: in each list the node whose values are the most common is the leader; each node is compared with the
   leader of most of its lists: an estimate from the union's sketch filters, the whole sets decide.
4. Components of these links are found. Only lists that still hold several components go on; they are cut into
   blocks of BLOCK members, and pairs of blocks are compared within a task, first on sketches alone: overlap and union
   estimate filter pairs of two components, a pair counts only in the list of the first value that its members share,
   and members without a partner drop out. For the others the whole sets are fetched and decide, and each task returns a
   spanning forest of its links. So every candidate pair is either within one component or decided on whole sets; no
   pairs are emitted, and whole sets are moved for pairs in about one list of the many that a pair may share.
5. Components of all links, each with the smallest id of its nodes' rows.

Defined results: null or empty texts have an empty set and are alone; with fewer than five words the whole sequence is
the one shingle; a row with a null id is alone with a null component, and is never a reason for another row to go; rows
that share an id have each its own text's component; equal texts are always together; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, text_slices, written
from .components import connected_components
from .shingles import jaccard_at_least, shingle_set, signature

SKETCH, OVERLAP, PERCENT, BLOCK = 32, 14, 75, 1024
#: Up to so many ids (8 bytes each) are broadcast to pick rows of documents; beyond, a shuffle does it.
BROADCAST_IDS = 1_000_000
#: A pair of blocks of a list.
_KEY = ("value", "i", "j")


def _signatures(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([signature(s) if len(s) else None for s in sets], pa.binary())


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sig, sketch) of each row; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            sets = [shingle_set(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), _signatures(sets), pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sig", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, n_shingles long, sig binary, sketch array<long>",
    )


def _picked(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id is in ids (_id), a written table."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["_id"], "left_semi")


def _sets(docs: DataFrame, nodes: DataFrame, repeats: bool, id_col: str, text: str) -> DataFrame:
    """(node, own): the whole shingle sets of nodes (node, rep), as bytes; own table. repeats: ids occur more than once."""
    picked = _picked(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text)), nodes.select(F.col("rep").alias("_id")).distinct(), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            sets = [shingle_set(t) for t in texts]
            yield pa.RecordBatch.from_arrays([_signatures(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

    found = picked.mapInArrow(run, "node binary, own binary")
    if repeats:  # one row a node, so that repeated rows don't multiply in joins
        found = found.filter("node is not null").groupBy("node").agg(F.any_value("own").alias("own"))
    return written(found, "sets")


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimated from the SKETCH smallest values of the union; a, b: sorted sets or sketches."""
    both = np.concatenate([a[:SKETCH], b[:SKETCH]])
    values, counts = np.unique(both, return_counts=True)
    return float((counts[:SKETCH] == 2).sum()) / max(1, min(SKETCH, len(values)))


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, own_a, own_b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(union_estimate(p, q) >= OVERLAP / SKETCH and jaccard_at_least(p, q, PERCENT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(run, "a binary, b binary")


class _Block:
    """The members of a pair of blocks: groups (components), sides (0: first block, 1: second), sizes, whole sets or sketches.

    same: one block, all its pairs count; else pairs of two sides. Values are numbered once, and a member's values are
    marked in a table, so one pass counts what all others share with it.
    """

    def __init__(
        self, groups: list, sides: list[int], sizes: list[int], sets: list[np.ndarray], same: bool, value: int = 0,
        listed: list[np.ndarray] | None = None,
    ):
        self.group, self.side, self.size, self.same = np.unique(np.array(groups), return_inverse=True)[1], np.array(sides), np.array(sizes), same
        held = np.array([len(s) for s in sets])
        self.values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts, self.held = np.concatenate([[0], np.cumsum(held)[:-1]]), held
        self.short = np.minimum(held, SKETCH)
        self.short_starts = np.concatenate([[0], np.cumsum(self.short)[:-1]])
        at = np.arange(self.short.sum()) - np.repeat(self.short_starts, self.short)
        self.short_flat = self.flat[np.repeat(self.starts, self.short) + at]
        # each member's retained values in a row, with numbers that nobody has where there are fewer
        self.sketch = np.full((len(sets), SKETCH), -1, np.int64)
        self.sketch[np.repeat(np.arange(len(sets)), self.short), at] = self.short_flat
        spare = self.sketch < 0
        self.sketch[spare] = len(self.values) + np.flatnonzero(spare.ravel())
        self.need = -(-self.short * OVERLAP // SKETCH)
        self.mark = np.zeros(len(self.values), np.int32)
        # the lists that each member is in, in one order for all, and the place of this list among them
        self.listed = None
        if listed is not None:
            width = max(map(len, listed))
            whole = np.array([np.concatenate([x, np.full(width - len(x), value)]) for x in listed])
            self.place = (whole == value).argmax(axis=1)
            names, numbers = np.unique(whole, return_inverse=True)
            self.listed, self.earlier = numbers.reshape(whole.shape), np.zeros(len(names), bool)

    def _partners(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` (a mask) in another group that the filters leave as possible links of i."""
        fit = among & (self.group != self.group[i]) & (100 * np.minimum(self.size, self.size[i]) >= PERCENT * np.maximum(self.size, self.size[i]))
        if not self.same:
            fit &= self.side != self.side[i]
        near = np.flatnonzero(fit)
        if len(near) and self.listed is not None and self.place[i]:
            # a pair that an earlier list has, too, is looked at there
            before = self.listed[i, : self.place[i]]
            self.earlier[before] = True
            near = near[~self.earlier[self.listed[near]].any(axis=1)]
            self.earlier[before] = False
        if len(near):
            need = np.minimum(self.need[near], self.need[i])
            near = near[
                (self.sketch[near, :, None] == self.sketch[i]).any(axis=2).sum(axis=1) >= need
            ] if len(near) <= 16 else near[self._shared(i)[near] >= need]
        return near[self._estimates(i, near) >= OVERLAP / SKETCH] if len(near) else near

    def _shared(self, i: int) -> np.ndarray:
        """How many retained values each member shares with i."""
        own = self.short_flat[self.short_starts[i] : self.short_starts[i] + self.short[i]]
        self.mark[own] = 1
        shared = np.add.reduceat(self.mark[self.short_flat], self.short_starts)
        self.mark[own] = 0
        return shared

    def possible(self) -> np.ndarray:
        """Members with a possible link. A member that has one is only compared with those that have none yet."""
        found = np.zeros(len(self.size), bool)
        for i in range(len(self.size)):
            near = self._partners(i, ~found)
            if not found[i] and not len(near):
                near = self._partners(i, found)
            found[near] = True
            found[i] |= len(near) > 0
            if found.all():
                break
        return np.flatnonzero(found)

    def _estimates(self, i: int, near: np.ndarray) -> np.ndarray:
        """union_estimate() of member i and each of near."""
        both = np.concatenate([self.sketch[near], np.broadcast_to(self.sketch[i], (len(near), SKETCH))], axis=1)
        both.sort(axis=1)
        again = both[:, 1:] == both[:, :-1]
        rank = np.arange(1, 2 * SKETCH) - np.cumsum(again, axis=1)  # of a repeated value among the distinct ones, from 0
        values = (both < len(self.values)).sum(axis=1) - again.sum(axis=1)
        return (again & (rank < SKETCH)).sum(axis=1) / np.maximum(1, np.minimum(SKETCH, values))

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links, decided on whole sets. Linked groups become one, and aren't compared again."""
        out = []
        after = np.ones(len(self.size), bool)
        for i in range(len(self.size)):
            after[i] = False
            near = self._partners(i, after)
            if not len(near):
                continue
            own = self.flat[self.starts[i] : self.starts[i] + self.held[i]]
            self.mark[own] = 1
            for j in near:
                if self.group[j] == self.group[i]:
                    continue
                both = int(self.mark[self.flat[self.starts[j] : self.starts[j] + self.held[j]]].sum())
                if 100 * both >= PERCENT * (self.size[i] + self.size[j] - both):
                    out.append((i, int(j)))
                    self.group[self.group == self.group[j]] = self.group[i]
            self.mark[own] = 0
        return out


def _by_block(rows: DataFrame, *numbers: str) -> DataFrame:
    """Rows dealt to tasks by block and sorted by it."""
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "side", "node", "component", "n", *numbers)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each block of batches from _by_block."""
    key, held = None, []
    for batch in batches:
        plain = [c.to_pylist() for c in batch.columns[:7]]
        for *k, side, node, component, n, own, listed in zip(
            *plain, batch.column(7), batch.column(8) if batch.num_columns > 8 else repeat(None, batch.num_rows), strict=True,
        ):
            if (k := tuple(k)) != key:
                if len(held) > 1:
                    yield key, held
                key, held = k, []
            held.append((side, node, component, n, own, listed))
    if len(held) > 1:
        yield key, held


def _block(key: tuple, rows: list[tuple], sets: list[np.ndarray]) -> _Block:
    side, _, component, n, _, listed = zip(*rows, strict=True)
    return _Block(
        list(component), list(side), list(n), sets, key[1] == key[2], key[0],
        None if listed[0] is None else [x.values.to_numpy() for x in listed],
    )


def _possible(rows: DataFrame) -> DataFrame:
    """Those members of blocks that have a possible link in them, by sketches; columns of _KEY, side, node, component, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _blocks(batches):
            use = _block(key, held, [r[4].values.to_numpy().view(np.uint64) for r in held]).possible()
            if len(use):
                some = [(*key, *held[i][:4]) for i in use]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)],
                    names=[*_KEY, "side", "node", "component", "n"],
                )

    return _by_block(rows, "sketch", "values").mapInArrow(run, "value long, i int, j int, side int, node binary, component binary, n long")


def _block_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between members of blocks, by whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _blocks(batches):
            if found := _block(key, held, [np.frombuffer(r[4].as_buffer(), np.uint64) for r in held]).links():
                yield pa.RecordBatch.from_arrays([pa.array([held[p[k]][1] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return _by_block(rows, "own").mapInArrow(run, "a binary, b binary")


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sig, component_id, first) of every row; first: its text is the one of its group to stay.

    That is the text of the group's smallest id and, of several such texts, the one with the least sig.
    """
    found = written(sketches(docs, id_col, text), "sketches")
    named = found.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(
        named.groupBy(F.col("sig").alias("node")).agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.any_value("n_shingles").alias("n"),
            F.any_value("sketch").alias("sketch"),
        ),
        "classes",
    )
    repeats = not named.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # inverted lists of the rarest retained values that more than one node has
    retained = classes.select("node", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    common = retained.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = retained.join(common, "value").groupBy("node", "m").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("h"), F.sum("df").alias("weight"),
    )
    need = F.ceil(F.col("m") * OVERLAP / SKETCH).cast("int")
    listed = written(
        ranked.filter(F.size("h") >= need).select(
            "node", "weight", F.slice(F.col("h.value"), F.lit(1), F.size("h") - need + 1).alias("values"),
        ),
        "lists",
    )
    lists = listed.select("node", "weight", F.explode("values").alias("value"))
    sets = _sets(docs, classes.join(listed.select("node"), "node", "left_semi").select("node", "rep"), repeats, id_col, text)
    # stars
    leaders = lists.groupBy("value").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    led = lists.join(leaders, "value").filter("node != leader").groupBy("node", "leader").agg(F.count("*").alias("k"))
    stars = led.groupBy("node").agg(F.max_by("leader", F.struct("k", "leader")).alias("b")).select(F.col("node").alias("a"), "b")
    pairs = stars.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    links = written(_verified(pairs), "stars")
    # what is left between components
    parts = connected_components(links).withColumnRenamed("node", "_node")
    placed = lists.join(parts, F.col("node") == F.col("_node"), "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("value").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"),
    ).filter("lo != hi").select("value", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    left = placed.join(mixed, "value").join(classes.select("node", "n", "sketch").join(listed.select("node", "values"), "node"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = left.select(
        "value", "node", "component", "n", "sketch", "values", block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    spread = spread.select(
        "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component", "n", "sketch", "values",
    )
    possible = written(_possible(spread), "possible")
    more = _block_links(possible.join(sets, "node"))
    final = connected_components(links.union(written(more, "links"))).withColumnRenamed("node", "_node")
    # names of groups; then back to rows, where only nodes of several rows or with a link need a look-up
    joined = classes.select("node", "rep", "rows").join(final, F.col("node") == F.col("_node"), "left").filter(F.col("component").isNotNull() | (F.col("rows") > 1)).select(
        "node", "rep", F.coalesce("component", "node").alias("component"),
    )
    joined = written(joined, "groups")
    least = joined.groupBy(F.col("component").alias("_component")).agg(F.min(F.struct("rep", "node")).alias("least"))
    groups = joined.join(least, F.col("component") == F.col("_component")).select(
        F.col("node").alias("sig"), F.col("least.rep").alias("component_id"),
        (F.col("least.node") == F.col("node")).alias("first"),
    )
    out = found.select("doc_id", "n_shingles", "sig").join(groups, "sig", "left")
    own = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_shingles", "sig", F.when(own, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("first", F.lit(True)).alias("first"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    out = labelled(docs, id_col, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of near copies: the one with the smallest id (of several texts with that id, the
    one whose shingles' digest is least).

    Rows with a null id stay. Of rows that share an id and a text one stays, with the other columns of the row that is
    least as JSON; a row that shares an id with others but is no copy stays, too. Empty texts with different ids stay. Other
    columns stay, whatever their names.
    """
    sig, whole, others_name = free(docs, "sig", "rest", "others")
    rows = labelled(docs, id_col, text).filter("doc_id is not null").select(
        F.col("doc_id").alias("_id"), "sig", (F.col("first") & (F.col("doc_id") == F.col("component_id"))).alias("stays"),
    )
    ids = rows.groupBy("_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays"))
    ids = written(ids.filter("n > 1 or not stays"), "gone")
    kept = _without(docs, ids.select("_id"), id_col)
    again = written(ids.filter("n > 1").select("_id"), "again")
    if again.isEmpty():
        return kept
    # ids of several rows: their texts are looked at once more, as an id alone doesn't tell which row stays
    repeated = _picked(docs, again, id_col)
    columns = [c for c in docs.columns if c not in (id_col, text)]
    others = F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    single = written(
        repeated.groupBy(id_col, text).agg(F.min_by(others, F.to_json(others)).alias(others_name)).select(
            F.col(id_col), F.col(text), *[F.col(others_name)[c].alias(c) for c in columns],
        ),
        "single",
    )
    stay = written(
        rows.join(
            F.broadcast(again) if again.count() <= BROADCAST_IDS else again, "_id", "left_semi",
        ).filter("stays").select("_id", "sig").distinct(),
        "stay",
    )
    schema = single.select("*", F.lit(None).cast("binary").alias(sig)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, _signatures([shingle_set(t) for t in texts])], names=[*part.schema.names, sig])

    signed = single.mapInArrow(run, schema)
    # of texts with one set of shingles, such as two spacings, the least stays
    picked = signed.join(stay, (signed[id_col] == stay["_id"]) & signed[sig].eqNullSafe(stay["sig"]), "left_semi")
    rest = F.struct(*[F.col(c) for c in docs.columns if c != id_col])
    least = picked.groupBy(F.col(id_col), sig).agg(F.min_by(rest, F.struct(F.col(text), F.to_json(rest))).alias(whole))
    return kept.unionByName(least.select(F.col(id_col), *[F.col(whole)[c].alias(c) for c in docs.columns if c != id_col]))


def _without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id isn't in ids (_id), a written table."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["_id"], "left_anti")
