"""Token counts as rollups that are maintained by deltas.

A change is signed: an insert adds a document's count to its (source, lang, tokenizer version), a delete takes it
away, and a revision takes the old count away and adds the new one. A batch of changes is rolled up, partly before the
shuffle, and written as one small table in a folder of its own; totals are the sum over the batches' tables.

A batch is committed by one empty file under commits/<batch id>/, whose name is that of the batch's table, which is
complete by then. As all that a commit says is in a name, it is there whole or not at all: a writer that dies before leaves
a table that nothing names, and the batch can be sent again. Of several writers of one batch the least name counts, so all readers
agree, whoever came first, and a batch that is in already is left alone. This needs a store that lists what has been
created, but neither renames nor creation that fails where there is a file.

compact() sums all batches into one base, in the same way: a file bases/<number>.<name> names its table. The base holds the
batches' ids as a table of its own, in which one id is looked up by a filter, so totals() doesn't read them. What
a base replaces is deleted only by a later compact(), when it has been replaced for `grace` seconds, so readers with older
plans end well.

Tokenizers by version: words, letters-and-digits, characters and bytes (byte-level tokens without merges) are columns;
bpe_counted() counts by any rank file of byte-level BPE (bpe.py).

Defined results: null sources, languages and versions are groups of their own; a null text or count is 0; groups whose
documents all went are not returned; repeated rows count each time; other columns are ignored; an empty ledger has no
totals.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import SPACE_CLASS, delete

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, documents long, tokens long"

#: Tokenizers by version: text -> number of tokens.
TOKENIZERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(SPACE_CLASS)),
    "alnum-1": lambda text: F.regexp_count(text, F.lit("[A-Za-z0-9]+")),
    "chars-1": lambda text: F.char_length(text),
    "bytes-1": lambda text: F.octet_length(text),
}


def counts(docs: DataFrame, *columns: str) -> DataFrame:
    """source, lang, the given columns, and a column for each version of TOKENIZERS: one scan of the texts for all."""
    own = [F.coalesce(f(F.col("text")), F.lit(0)).cast("long").alias(v) for v, f in TOKENIZERS.items()]
    return docs.select("source", "lang", *columns, *own)


def counted(rows: DataFrame, version: str, count: Column | None = None) -> DataFrame:
    """(source, lang, version, tokens) of each row of counts(), or of rows with a count of their own."""
    own = F.col(f"`{version}`") if count is None else count
    return rows.select("source", "lang", F.lit(version).alias("version"), F.coalesce(own, F.lit(0)).cast("long").alias("tokens"))


def bpe_counted(docs: DataFrame, version: str, path: str, pattern: str) -> DataFrame:
    """The same by a rank file; version should name it."""
    return bpe.counts(docs, path, pattern, ("source", "lang")).select("source", "lang", F.lit(version).alias("version"), "tokens")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def revisions(rows: DataFrame, version: str, old: Column, new: Column | None = None) -> DataFrame:
    """For each row of counts() a delete of its old count and an insert of its new one."""
    fresh = F.col(f"`{version}`") if new is None else new
    both = F.array(
        F.struct(F.lit(-1).alias("sign"), F.coalesce(old, F.lit(0)).cast("long").alias("tokens")),
        F.struct(F.lit(1).alias("sign"), F.coalesce(fresh, F.lit(0)).cast("long").alias("tokens")),
    )
    return rows.select("source", "lang", F.lit(version).alias("version"), F.inline(both))


def _rolled(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(
        F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"),
    ).filter((F.col("documents") != 0) | (F.col("tokens") != 0))


class TokenLedger:
    """Batches of changes under one folder of a file system that all machines share.

    commits/<batch id>/<table> and bases/<number>.<table> are empty files; tables are folders of these names, and a base's
    ids stand in <table>-ids. Any number of writers may commit; compact() is for one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, grace: float = 3600.0):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(n for s in self._fs.listStatus(self._at(folder)) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _state(self) -> tuple[list[str], dict[str, str]]:
        """The bases, oldest first, and the table of each batch that the newest doesn't hold, by id."""
        bases = self._names("bases")
        found: dict[str, str] = {}
        if self._fs.exists(self._at("commits")):
            files = self._fs.listFiles(self._at("commits"), True)
            while files.hasNext():
                at = files.next().getPath()
                batch, table = at.getParent().getName(), at.getName()
                if not table.startswith((".", "_")):
                    found[batch] = min(table, found.get(batch, table))
        held = self._held(bases[-1], list(found)) if bases and found else set()
        return bases, {b: t for b, t in found.items() if b not in held}

    @staticmethod
    def _table(base: str) -> str:
        return base.split(".", 1)[1]

    def _ids(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/{self._table(base)}-ids")

    def _held(self, base: str, batches: list[str]) -> set[str]:
        """Which of these batches the base holds: only those still listed under commits are asked for."""
        return {r["batch"] for r in self._ids(base).filter(F.col("batch").isin(batches)).collect()}

    def has(self, batch_id: str) -> bool:
        if self._names(f"commits/{batch_id}"):
            return True
        bases = self._names("bases")
        return bool(bases) and bool(self._held(bases[-1], [batch_id]))

    def batches(self) -> list[str]:
        bases, fresh = self._state()
        return sorted({*fresh, *(r["batch"] for r in self._ids(bases[-1]).collect())} if bases else fresh)

    def _mark(self, name: str) -> None:
        """An empty file."""
        self._fs.create(self._at(name), True).close()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Roll the changes (KEYS, tokens, sign) up and commit them; False where the batch is in already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,199}", batch_id):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-'")
        if self.has(batch_id):
            return False
        table = f"data-{batch_id}-{uuid.uuid4().hex[:12]}"  # each writer writes by itself
        signed = changes.select(*KEYS, F.col("sign").alias("documents"), (F.col("sign") * F.col("tokens")).alias("tokens"))
        _rolled(signed).write.parquet(f"{self.path}/{table}")
        self._mark(f"commits/{batch_id}/{table}")
        if self._names(f"commits/{batch_id}")[:1] == [table]:
            return True
        for name in (f"commits/{batch_id}/{table}", table):  # another writer's counts
            delete(self.spark, f"{self.path}/{name}")
        return False

    def _rows(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables]) if tables else self.spark.createDataFrame([], _SCHEMA)

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over the base and all batches that it lacks."""
        bases, fresh = self._state()
        return _rolled(self._rows([*map(self._table, bases[-1:]), *fresh.values()]))

    def compact(self) -> int:
        """Sum all batches into a new base, then delete what was replaced longer than `grace` ago; how many batches were summed."""
        bases, fresh = self._state()
        if fresh:
            table = f"base-{uuid.uuid4().hex[:12]}"
            _rolled(self._rows([*map(self._table, bases[-1:]), *fresh.values()])).coalesce(1).write.parquet(f"{self.path}/{table}")  # groups, not documents
            ids = self.spark.createDataFrame([(b,) for b in sorted(fresh)], "batch string")
            (self._ids(bases[-1]).unionByName(ids) if bases else ids).write.parquet(f"{self.path}/{table}-ids")
            number = int(bases[-1].split(".", 1)[0]) + 1 if bases else 1
            self._mark(f"bases/{number:012d}.{table}")
            bases = [*bases, f"{number:012d}.{table}"]
        self._clear(bases)
        return len(fresh)

    def _clear(self, bases: list[str]) -> None:
        """Delete older bases, and batches that the newest base holds, if that base has been there for `grace` seconds."""
        if not bases or time.time() - self._fs.getFileStatus(self._at(f"bases/{bases[-1]}")).getModificationTime() / 1000 < self.grace:
            return
        listed = self._names("commits")
        for batch in sorted(self._held(bases[-1], listed)) if listed else []:
            for table in self._names(f"commits/{batch}"):
                delete(self.spark, f"{self.path}/{table}")
            delete(self.spark, f"{self.path}/commits/{batch}")
        for base in bases[:-1]:
            for name in (f"bases/{base}", self._table(base), f"{self._table(base)}-ids"):
                delete(self.spark, f"{self.path}/{name}")
