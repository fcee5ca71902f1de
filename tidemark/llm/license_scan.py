"""License scans over a positional rare-token index.

A template is a licence notice as words. Its words' inverse document frequency is measured on the whole corpus;
the template's rarest words are its anchors. A file looks up only its anchor words, rarest first; each hit gives
the place where the template would start (file position - template position). Where enough of a template's anchors
agree on one start, the mandatory key phrases are verified word by word, and the label is given.

A base phrase is a template that is all key phrase. One anchor is enough for it, so each of its places is found.

Defined results: a null or empty text has no words, no labels and score 0; ties in rarity go to the earlier word in
code point order; repeated rows give repeated results; other columns of the input are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Bytes to words: 0-9, a-z and bytes from 128 stay, A-Z are lowered, all others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """label; notice: all words; keys: phrases of the notice that must stand at their places."""

    label: str
    notice: str
    keys: tuple[str, ...]
    base: bool = False


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), True)


BASE = (_base("cc-by", "cc by"), _base("gpl", "general public license"), _base("reserved", "all rights reserved"))
EXTRA = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    # whole notices, as files carry them; their key phrases have to stand at their distances from one another
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("use copy modify merge publish distribute sublicense", "the above copyright notice and this permission notice", "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing", "governing permissions and limitations under the license"),
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("you can redistribute it and or modify it", "either version 3 of the license", "in the hope that it will be useful"),
    ),
    Template(
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "to endorse or promote products derived from this software"),
    ),
)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = BASE + EXTRA, text: str = "text") -> dict[bytes, int]:
    """In how many documents each licence word stands; no more entries than the templates have words."""
    vocab = frozenset(w for t in templates for w in t.notice.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for _, texts in text_slices(batches, text):
            for t in texts:
                found.update(vocab.intersection(words(t)))
        yield pa.RecordBatch.from_pydict(
            {"word": [w.decode() for w in found], "n": list(found.values())},
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]),
        )

    rows = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocab} | {r["word"].encode(): r["n"] for r in rows}


class Index:
    """Postings of anchor words: word -> [(template number, position)], with templates' key phrases."""

    def __init__(self, templates: tuple[Template, ...], df: dict[bytes, int], anchors: int = 4):
        self.templates, self.df = templates, df
        self.notice = [t.notice.encode().split() for t in templates]
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        self.need: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            own = self.notice[k]
            phrases = [p.encode().split() for p in t.keys]
            places = [next(i for i in range(len(own)) if own[i : i + len(p)] == p) for p in phrases]
            self.keys.append(list(zip(places, phrases, strict=True)))
            # anchors stand inside key phrases: where all keys hold, every anchor does
            inside = sorted({i for at, p in self.keys[-1] for i in range(at, at + len(p))}, key=lambda i: (df[own[i]], own[i], i))
            chosen = inside[:1] if t.base else inside[:anchors]
            self.need.append(len(chosen))
            for i in chosen:
                self.postings[own[i]].append((k, i))
        self.postings = dict(self.postings)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Base places (start, end, label) and verified notices (start, end, label, share of the notice's words in place)."""
        postings = self.postings
        hits = [i for i, w in enumerate(ws) if w in postings]
        base, found = [], []
        if not hits:
            return base, found
        votes: Counter[tuple[int, int]] = Counter()
        for i in sorted(hits, key=lambda i: (self.df[ws[i]], ws[i], i)):  # rarest words first
            for k, at in postings[ws[i]]:
                votes[k, i - at] += 1
        for (k, start), n in votes.items():
            if n < self.need[k] or any(ws[start + at : start + at + len(p)] != p for at, p in self.keys[k] if start + at >= 0) or any(start + at < 0 for at, _ in self.keys[k]):
                continue
            own, label = self.notice[k], self.templates[k].label
            same = sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(own))
            if self.templates[k].base:
                base.append((start, start + len(own), label))
            found.append((max(start, 0), min(start + len(own), len(ws)), label, same / len(own)))
        return sorted(base), sorted(found)


def license_scan(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + EXTRA, anchors: int = 4, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: id, n_words, base places, and notices as array<struct<start, end, label, score>>.

    Two passes over the texts and one shuffle of at most (licence words x tasks) counts; no text is shuffled.
    """
    index = Index(templates, document_frequencies(docs, templates, text), anchors)
    place = "start: bigint, `end`: bigint, label: string"
    out = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64())] + [(c, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())] + more))) for c, more in (("base", []), ("notices", [("score", pa.float64())]))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            n, bases, notices = [], [], []
            for t in texts:
                ws = words(t)
                base, found = index.scan(ws)
                n.append(len(ws))
                bases.append([{"start": a, "end": b, "label": c} for a, b, c in base])
                notices.append([{"start": a, "end": b, "label": c, "score": s} for a, b, c, s in found])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(bases, out.field(2).type),
                    pa.array(notices, out.field(3).type),
                ],
                schema=out,
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(
        scan, f"{id_col} long, n_words long, base array<struct<{place}>>, notices array<struct<{place}, score: double>>",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from license_scan()'s."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        joined("base").alias("base_labels"), joined("notices").alias("labels"),
        F.coalesce(F.array_max("notices.score"), F.lit(0.0)).alias("score"),
    )
