"""License scans of whole texts.

A notice is searched with bounded errors: cut into one more piece than it may have errors, at least one
piece stands unchanged in every match (pigeonhole), so exact seeds find candidates: the runs of whole words
around a seed whose length can fit. The regex library's bounded-error matching verifies each run as a whole,
says with how many edits, and the best one around a seed gives the span. Texts are normalised first: A-Z
lowered, words joined by one blank. A notice without errors is a base place; the places within the error
bound add labels.

Null or empty text: no words, no places, null first and last word, empty labels, score 0. Repeated rows
are scanned one by one; a notice that occurs often counts at each place, and of runs with equal edits the
first one is the span. Very long texts: the work is linear in the text and in the seeds found. Only doc_id
and text are read, so other columns cannot clash. Empty input: empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from seedsift.llm.common import ALNUM, map_batches

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,stop:int,edits:int>>"


@dataclass(frozen=True)
class Notice:
    """words: its text as normalised; edits: most inserted, deleted or changed characters; base: exact places count as base."""

    label: str
    words: str
    edits: int
    base: bool = False


#: Identifiers behind `spdx license identifier`, as normalised, and their labels; an edit may make another identifier, so none is allowed.
IDENTIFIERS = {
    "0bsd": "0bsd", "agpl 3 0": "agpl-3", "apache 2 0": "apache-2", "artistic 2 0": "artistic-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsl 1 0": "bsl-1", "cc by 4 0": "cc-by", "cc by nc 4 0": "cc-by-nc",
    "cc by nc nd 4 0": "cc-by-nc-nd", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nd 4 0": "cc-by-nd", "cc by sa 4 0": "cc-by-sa", "cc0 1 0": "cc0", "cddl 1 0": "cddl-1", "epl 2 0": "epl-2", "eupl 1 2": "eupl-1", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3",
    "isc": "isc", "lgpl 2 1": "lgpl-2", "lgpl 3 0": "lgpl-3", "mit": "mit", "mpl 2 0": "mpl-2", "ofl 1 1": "ofl-1", "unlicense": "unlicense", "zlib": "zlib",
}
#: (label, words, edits) of names and short notices.
NAMED = (
    ("gpl-3", "gnu general public license version 3", 3), ("gpl-2", "gnu general public license version 2", 0), ("gpl", "gnu general public license", 2), ("lgpl", "gnu lesser general public license", 2),
    ("lgpl", "gnu library general public license", 2), ("agpl", "gnu affero general public license", 2), ("gfdl", "gnu free documentation license", 2), ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd-2", "bsd 2 clause license", 0), ("bsd-3", "bsd 3 clause license", 0), ("bsd-2", "simplified bsd license", 2), ("bsd-3", "modified bsd license", 1), ("bsd-3", "new bsd license", 1),
    ("mit", "permission is hereby granted free of charge", 3), ("mit", "terms of the mit license", 2), ("isc", "isc license", 0), ("isc", "permission to use copy modify and or distribute this software", 4),
    ("apache-2", "licensed under the apache license", 2), ("apache", "apache software license", 2), ("mpl-2", "mozilla public license", 2), ("epl", "eclipse public license", 2), ("eupl", "european union public licence", 2),
    ("cddl", "common development and distribution license", 3), ("bsl", "boost software license", 2), ("artistic", "artistic license", 1), ("zlib", "zlib license", 0), ("psf", "python software foundation license", 2),
    ("ms-pl", "microsoft public license", 2), ("ofl", "sil open font license", 2), ("afl", "academic free license", 2), ("osl", "open software license", 1), ("unlicense", "the unlicense", 0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4), ("cc-by-nc", "creative commons attribution noncommercial", 2), ("cc-by-nc", "creative commons attribution non commercial", 2),
    ("cc-by-sa", "creative commons attribution sharealike", 2), ("cc-by-sa", "creative commons attribution share alike", 2), ("cc-by-nd", "creative commons attribution noderivatives", 2),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", 2), ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", 2), ("cc-by", "creative commons attribution 4 0 international", 1),
    ("cc0", "creative commons zero", 1), ("cc0", "cc0 1 0 universal", 0), ("cc0", "public domain dedication", 1), ("cc-by", "cc by 4 0", 0), ("cc-by-sa", "cc by sa", 0), ("cc-by-nd", "cc by nd", 0),
    ("cc-by-nc-sa", "cc by nc sa", 0), ("cc-by-nc-nd", "cc by nc nd", 0),
)
NOTICES = (
    Notice("mit", "under the mit license", 2, True),
    Notice("apache-2", "apache license version 2", 2, True),
    Notice("cc-by-nc", "cc by nc", 0, True),
    *(Notice(*x) for x in NAMED),
    *(Notice(label, f"spdx license identifier {x}", 0) for x, label in IDENTIFIERS.items()),
)
#: Most notices of a table: they go to every worker.
MOST_NOTICES = 10_000


def notices_of(rows: DataFrame) -> tuple[Notice, ...]:
    """Notices of a table (label, words, edits, base); words are normalised as texts are, and rows without words are left out."""
    found = rows.select("label", "words", "edits", "base").where("words is not null and label is not null").distinct().limit(MOST_NOTICES + 1).collect()
    if len(found) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    flat = lambda t: b" ".join(t.encode().translate(ALNUM).split()).decode()
    return tuple(Notice(r.label, flat(r.words), r.edits or 0, bool(r.base)) for r in sorted(found, key=str) if flat(r.words))


def pieces(words: str, edits: int) -> list[bytes]:
    """edits + 1 pieces of nearly equal length: a match with so many errors leaves one of them whole."""
    n, k = len(words), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [words[a:b].encode() for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = [(x, pieces(x.words, x.edits)) for x in notices]
        #: A notice's patterns with up to 0, 1, ... errors: the first one that a run matches as a whole says its edits.
        self.within = {x: [regex.compile(b"(?:%s){e<=%d}" % (regex.escape(x.words).encode(), e)) for e in range(x.edits + 1)] for x in notices}

    def exact(self, text: bytes, words: bytes) -> list[int]:
        """Starts of whole-word places in a text that has a blank at both ends; places may overlap."""
        out, at = [], text.find(b" " + words + b" ")
        while at >= 0:
            out.append(at + 1)
            at = text.find(b" " + words + b" ", at + 1)
        return out

    def edits(self, notice: Notice, text: bytes, start: int, stop: int) -> int | None:
        """By how many edits text[start:stop] differs from the notice, or None beyond its bound."""
        patterns = self.within[notice]
        if not patterns[-1].fullmatch(text, start, stop):
            return None
        return next(e for e, p in enumerate(patterns) if p.fullmatch(text, start, stop))

    def fuzzy(self, text: bytes, blanks: np.ndarray, notice: Notice, seeds: list[bytes]) -> list[tuple[int, int, int]]:
        """Disjoint whole-word spans within the bound, as (start, stop, edits); the best one around each seed."""
        places, offset, size, most = set(), 0, len(notice.words), notice.edits
        for seed in seeds:
            at = text.find(seed)
            while at >= 0:
                places.add(at - offset)
                at = text.find(seed, at + 1)
            offset += len(seed)
        out, last, known = [], 0, {}
        for place in sorted(places):
            found = []
            a, b = np.searchsorted(blanks, (max(last, place - most - 1), place + most))
            for start in (blanks[a:b] + 1).tolist():
                c, d = np.searchsorted(blanks, (start + size - most, start + size + most + 1))
                for stop in blanks[c:d].tolist():
                    if (start, stop) not in known:
                        known[start, stop] = self.edits(notice, text, start, stop)
                    if known[start, stop] is not None:
                        found.append((known[start, stop], start, stop))
            if found:
                e, start, last = min(found)
                out.append((start, last, e))
        return out

    def scan(self, text: str | None) -> tuple:
        flat = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split())
        if not flat:
            return 0, 0, None, None, "", "", 0.0, []
        flat = b" " + flat + b" "
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        base: list[int] = []
        base_labels, labels, spans, best = set(), set(), [], 0.0
        for notice, seeds in self.notices:
            if not any(s in flat for s in seeds):
                continue
            exact, size = self.exact(flat, notice.words.encode()), len(notice.words)
            found = [(a, a + size, 0) for a in exact]
            if notice.edits:
                # Exact places have one length, so those that a span overlaps start between two bounds.
                near = self.fuzzy(flat, blanks, notice, seeds)
                found += [x for x in near if bisect_right(exact, x[0] - size) == bisect_left(exact, x[1])]
            if notice.base and exact:
                base += exact
                base_labels.add(notice.label)
            for a, b, e in found:
                labels.add(notice.label)
                first, stop = np.searchsorted(blanks, (a, b)).tolist()
                spans.append({"label": notice.label, "start": first - 1, "stop": stop, "edits": e})
                best = max(best, 1.0 - e / (notice.edits + 1))
        at = np.searchsorted(blanks, sorted(base)).tolist()
        spans.sort(key=lambda s: (s["start"], s["stop"], s["label"]))
        return len(blanks) - 1, len(at), at[0] - 1 if at else None, at[-1] - 1 if at else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), best, spans


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, words, base places, labels, score and spans (in words, stop excluded) of every row of (doc_id, text)."""
    made: list[Scanner] = []
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def run(ids, texts):
        if not made:
            made.append(Scanner(notices))
        return {"doc_id": ids} | dict(zip(names, zip(*(made[0].scan(t) for t in texts))))

    return map_batches(docs, ["doc_id", "text"], run, SCHEMA)


def op5_license_scan(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
