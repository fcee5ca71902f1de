"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), with G(x) the set of the
text's byte n-grams of 1 to 4 (hashed to DIMS). Nystroem landmarks stand for the training rows; one-versus-rest kernel
ridge regression is solved on the driver over the fitted sample. As the kernel is an inner product of presence
vectors, the landmarks' weights fold into one DIMS x languages matrix, and batches of texts are scored by one matrix
product.

The fit takes a bounded sample, as the round's contract allows: SAMPLE rows, LANDMARKS of them as landmarks. Rows are
drawn by a hash, with equal shares for each language. Prediction covers every row and whole texts.

Defined results: `und` with score 0 where the text is null, empty or has no letter, or where no row was labelled;
ties go to the language that is first in code point order; repeated rows give repeated results, and rows that share an
id and a language train as one; other columns are ignored, and lang only counts in training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col, text_slices

DIMS_BITS, ORDERS, SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 15, 4, 1024, 256, 1e-2, 8.0
DIMS = 1 << DIMS_BITS
_LETTER = regex.compile(r"\p{L}").search
_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def presence(text: str, into: np.ndarray) -> None:
    """Set into[i] for each n-gram of the text; into: DIMS zeros. A-Z are lowered; edges count as spaces."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8).astype(np.uint32)
    code = raw
    for n in range(ORDERS):
        if n:
            if len(raw) <= n:
                return
            code = (code[:-1] << np.uint32(8)) | raw[n:]
        into[(code * _ODD[n] + np.uint32(n * 40503)) >> np.uint32(32 - DIMS_BITS)] = 1


def _dense(grams: list[np.ndarray]) -> np.ndarray:
    """Presence rows of unit length."""
    out = np.zeros((len(grams), DIMS), np.float32)
    for row, g in zip(out, grams, strict=True):
        row[g] = 1 / np.sqrt(max(1, len(g)))
    return out


@dataclass
class Model:
    """languages in code point order; weights: DIMS x languages."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Ridge outputs, texts x languages, by one product."""
        rows = np.zeros((len(texts), DIMS), np.uint8)
        for row, t in zip(rows, texts, strict=True):
            presence(t, row)
        norm = np.sqrt(rows.sum(axis=1, dtype=np.int64)).astype(np.float32)
        return rows.astype(np.float32) @ self.weights / norm[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores from 0 to 1 and the languages' ridge outputs; und, 0 and 0 without a letter.

        An output is near 1 for a text like the language's training texts and near 0 for one that shares few n-grams with
        them, however many languages there are; a score is a share among the languages that are known.
        """
        labels, scores, outputs = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if self.languages and _LETTER(t)]
        for at in range(0, len(use), 64):
            some = use[at : at + 64]
            out = self.scores([texts[i] for i in some])
            e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
            best, share = out.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)
            for i, b, s, o in zip(some, best, share, out.max(axis=1), strict=True):
                labels[i], scores[i], outputs[i] = self.languages[b], float(s), float(o)
        return labels, scores, outputs


def fit(
    labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text: str = "text",
    lang: str = "lang",
) -> Model:
    """labelled: training rows only. The driver gets `sample` rows' n-gram numbers (at most DIMS each); the languages are those
    of the sample, so at most as many."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").cast("double").alias("_n"))
    unit = (F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    # smallest unit * count: as many rows of each language, however rare it is
    weighed = rows.select(F.col(id_col).alias("id"), F.col(lang).alias("_own"), unit.alias("_unit")).join(counts, F.col("_own") == F.col("_lang"))
    chosen = weighed.select("id", (F.col("_unit") * F.col("_n")).alias("key")).orderBy("key", "id").limit(sample).collect()
    ids = [r["id"] for r in chosen if r["id"] is not None]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            found = []
            for t in texts:
                row = np.zeros(DIMS, np.uint8)
                presence(t, row)
                found.append(np.flatnonzero(row).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["id", "lang", "grams"])

    known = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"),
    ).filter(F.col("id").isin(ids)) if ids else rows.limit(0).select(F.lit(0).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # one row for each id and language, however many rows repeat it: this bounds what the driver gets
    single = known.mapInArrow(grams, "id long, lang string, grams binary").groupBy("id", "lang").agg(F.min("grams").alias("grams"))
    got = sorted({(r["id"], r["lang"]): np.frombuffer(r["grams"], np.int32) for r in single.collect()}.items())
    if not got:
        return Model([], np.zeros((DIMS, 0), np.float32))
    languages = sorted({k[1] for k, _ in got})
    target = np.array([[float(k[1] == c) for c in languages] for k, _ in got])
    # landmarks: every step-th row of those in order of language and id
    order = sorted(range(len(got)), key=lambda i: (got[i][0][1], got[i][0][0]))[:: max(1, len(got) // landmarks)]
    marks = _dense([got[i][1] for i in order])
    k_nm = np.concatenate([_dense([g for _, g in got[at : at + 64]]) @ marks.T for at in range(0, len(got), 64)]).astype(np.float64)
    k_mm = k_nm[order]
    share = 1 / np.maximum(target.sum(axis=0), 1)
    balance = (target @ share)[:, None] * len(got) / max(1, len(languages))
    system = k_nm.T @ (balance * k_nm) + RIDGE * len(got) / len(order) * k_mm + 1e-8 * np.eye(len(order))
    alpha = np.linalg.solve(system, k_nm.T @ (balance * target))
    return Model(languages, (marks.T @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score and output (which replace columns of these names), for every row.

    The model is of a bounded size and travels with the task.
    """
    docs = docs.drop("lang_pred", "score", "output")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("output")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            labels, scores, outputs = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(outputs, pa.float64())],
                names=[*part.schema.names, "lang_pred", "score", "output"],
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's digest: train on folds other than 2 of 4, predict all."""
    model = fit(docs.select(id_col, "text", "lang").filter(fold_col(F.col(id_col), 4) != 2), id_col=id_col)
    return predict(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", (fold_col(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
    )
