"""Ports of a question against the catalog of ports: resolution of tokens, membership, and the scope of a question."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.clean import CODE_SHAPE
from .router import COUNTRIES, NO_PORTS, Question, is_code, words

# Ports by names that people use.
ALIASES = {
    "gothenburg": "SEGOT", "goteborg": "SEGOT", "goteborgs": "SEGOT", "gdansk": "PLGDN", "gdynia": "PLGDY", "klaipeda": "LTKLJ", "riga": "LVRIX",
    "kotka": "FIKTK", "swinoujscie": "PLSWI", "szczecin": "PLSZZ", "sodertalje": "SESOE",
}
# End of the fixed values.

#: Catalogs beyond this number of ports are refused: a catalog is held on the driver and sent to tasks.
MOST_PORTS, LEAST_RATIO, MOST_SCANNED = 100_000, 0.80, 8


def plain(name: str | None) -> str:
    """Accents and other marks folded, blanks squeezed, lower case, a leading `port of` dropped."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return " ".join(bare.lower().split()).removeprefix("port of ")


def bare(code: str | None) -> str:
    return re.sub("[^A-Z0-9]", "", (code or "").upper())


@dataclass(frozen=True)
class Port:
    """One port: key, code, names, arrivals; structured: from visits and with a code of five letters."""

    key: str
    code: str = ""
    label: str = ""
    name: str = ""
    arrivals: float = 0.0
    structured: bool = False


@dataclass
class Scope:
    """A question's port after resolution. candidates: (source, token, resolved, known)."""

    port: str | None
    candidates: list[tuple[str, str, str, bool]] = field(default_factory=list)
    note: str | None = None


class Catalog:
    """Ports of a bounded catalog. Resolution takes the first step that finds something: the shape of a code, an alias, an
    equal key or code, a name that contains the token, the most alike name of LEAST_RATIO or more; then the token itself.

    Of several ports, structured ones come first, then those with most arrivals, then the least key. A five-letter name
    has the shape of a code and goes no further, whatever its alias.
    """

    def __init__(self, ports: list[Port]):
        self.ports = sorted(ports, key=lambda p: (-p.arrivals, p.key))
        self.known_codes = {bare(x) for p in ports for x in (p.key, p.code) if x}
        self.names = [(plain(p.label), plain(p.name)) for p in self.ports]

    @classmethod
    def of(cls, rows: DataFrame) -> Catalog:
        """From port_key and, where there, locode_norm, port_label, port_name_norm, arrivals_total, source_kind."""
        have = [c for c in ("port_key", "locode_norm", "port_label", "port_name_norm", "arrivals_total", "source_kind") if c in rows.columns]
        got = rows.select(*have).filter("port_key is not null").limit(MOST_PORTS + 1).collect()
        if len(got) > MOST_PORTS:
            raise ValueError(f"a catalog of more than {MOST_PORTS} ports")
        out = []
        for r in got:
            d = r.asDict()
            code = (d.get("locode_norm") or "").upper()
            own = (d.get("source_kind") or "").lower() in ("port_call", "visits") and re.fullmatch("[A-Z]{5}", code) is not None
            out.append(
                Port(
                    str(d["port_key"]), code, d.get("port_label") or str(d["port_key"]), d.get("port_name_norm") or "",
                    float(d.get("arrivals_total") or 0), own,
                )
            )
        return cls(out)

    def _best(self, found: list[int], rank=lambda i: 0.0) -> str | None:
        """Of ports by number: structured ones if any, then by rank, arrivals and key."""
        some = [i for i in found if self.ports[i].structured] or found
        return self.ports[max(some, key=lambda i: (rank(i), -i))].key if some else None

    def resolve(self, token: str | None) -> str | None:
        """The port's key, the code that the token has the shape of, or the token."""
        token = (token or "").strip()
        if not token:
            return None
        tight = token.upper().replace(" ", "")
        if re.fullmatch(CODE_SHAPE, token):
            return tight
        name = plain(token)
        if name in ALIASES:
            return ALIASES[name]
        if (same := next((p.key for p in self.ports if tight in (p.key.upper(), p.code)), None)) is not None:
            return same
        if inside := self._best([i for i, own in enumerate(self.names) if any(name in x for x in own)]):
            return inside
        ratio = [max((SequenceMatcher(None, name, x).ratio() for x in own if x), default=0.0) for own in self.names]
        return self._best([i for i, r in enumerate(ratio) if r >= LEAST_RATIO], lambda i: ratio[i]) or token

    def resolve_all(self, tokens: list[str]) -> list[str]:
        return list(dict.fromkeys(self.resolve(t) or t for t in tokens))

    def known(self, token: str | None) -> bool:
        """Whether the token is a port's key or code; without a catalog, whether it has the shape of a code."""
        code = (token or "").strip().upper().replace(" ", "")
        return bool(code) and (bare(code) in self.known_codes if self.ports else re.fullmatch("[A-Z]{5}", code) is not None)

    def scope(self, q: Question, override: str | None = None) -> Scope:
        """The first token that the catalog knows: the override, the question's ports, then what a scan of it finds."""
        sources = [("filter", override), *(("question", p) for p in q.ports), *(("scan", t) for t in scan(q.text))]
        tokens = {t.strip(): s for s, t in reversed(sources) if t and t.strip()}
        order = list(dict.fromkeys(t.strip() for _, t in sources if t and t.strip()))
        found = [(tokens[t], t, r, self.known(r)) for t in order for r in [self.resolve(t) or t]]
        port = next((r for _, _, r, known in found if known), None)
        if port is None and override and override.strip():
            port = self.resolve(override)
        stated = (override or "").strip() or q.port
        note = None
        if stated and port and stated != port:
            note = f"port {stated} read as {port}"
        elif stated and port is None:
            note = f"port {stated} left out: the catalog has no such port"
        return Scope(port, found, note)


def scan(text: str) -> list[str]:
    """Code-shaped words and pairs of words, and aliases anywhere in the question; MOST_SCANNED at most."""
    ws, out = words(text), []
    for w, after in zip(ws, [*ws[1:], None], strict=True):
        pair = w.text + after.text if after and len(w.text) == 2 and len(after.text) == 3 and not w.stop else ""
        out += [
            t.upper() for t in (w.text, pair) if len(t) == 5 and t.isalpha() and t[:2].upper() in COUNTRIES and t.upper() not in NO_PORTS and is_code(t)
        ]
    low = plain(text)
    return list(dict.fromkeys([*out, *(a for a in ALIASES if a in low)]))[:MOST_SCANNED]


def resolved(tokens: DataFrame, catalog: Catalog, column: str = "token") -> DataFrame:
    """(column, resolved, known) of a table of tokens; null tokens resolve to null. The catalog travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            memo = {t: catalog.resolve(t) for t in set(own)}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([memo[t] for t in own], pa.string()),
                    pa.array([catalog.known(memo[t]) for t in own], pa.bool_()),
                ],
                names=[column, "resolved", "known"],
            )

    return tokens.select(tokens[column].cast("string").alias(column)).mapInArrow(run, f"{column} string, resolved string, known boolean")
