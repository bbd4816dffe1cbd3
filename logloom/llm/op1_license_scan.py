"""License scan: exact seeds from a pigeonhole split locate candidates, bounded-error matching verifies them.

A notice of n characters is searched with at most k edits. Cut into k + 1 pieces, at least one piece occurs
exactly in any such match, so an automaton over all pieces finds every candidate place; only the stretch around
a piece is then matched with the regex library's error bound, which reports span and edits. A match begins and ends with
whole words. Edits are counted in bytes of the folded text, so a letter outside ASCII counts as its UTF-8 bytes.

Edge cases: a null id keeps its row; a null text counts as empty and gives zero words, no labels and score 0; repeated rows each give a row;
an empty table gives no rows; other columns of the input are ignored. Whole texts are searched, whatever their length.
"""

from __future__ import annotations

import bisect
import heapq

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices searched with errors, as words in lower case; label: notices.
NOTICES = {
    "artistic-2.0": ["the artistic license 2 0"],
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by": ["creative commons attribution 4 0", "creative commons attribution license"],
    "boost": ["boost software license version 1 0"],
    "cc-by-nc": ["creative commons attribution noncommercial"],
    "cc-by-sa": ["creative commons attribution sharealike"],
    "cc0": ["creative commons zero public domain dedication"],
    "cddl": ["common development and distribution license"],
    "epl-2.0": ["eclipse public license version 2 0"],
    "gfdl": ["gnu free documentation license"],
    "gpl": ["licensed under the gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge"],
    "mpl-2.0": ["mozilla public license version 2 0"],
    "ofl-1.1": ["sil open font license version 1 1"],
    "public-domain": ["released into the public domain"],
    "reserved": ["all rights are reserved by the author", "no part of this publication may be reproduced"],
    "unlicense": ["this is free and unencumbered software"],
    "zlib": ["provided as is without any express or implied warranty"],
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12
#: A window runs on to the end of a word, unless that is so far away that no notice ends there.
LONG_WORD = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int>>"
SCHEMA = f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): notice cut into k + 1 nearly equal pieces."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Small per-task helper that scans one text at a time."""

    def __init__(self, notices: dict[str, list[str]]):
        self.notices = [(label, x, max(1, len(x) // CHARS_PER_EDIT)) for label, xs in sorted(notices.items()) for x in xs]
        self.patterns = [regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(x)}){{e<={k}}}(?![^ ])") for _, x, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x, k) in enumerate(self.notices):
            for at, piece in pieces(x, k):
                seeds.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def best(self, which: int, text: str, lo: int, hi: int) -> list[tuple]:
        """The match of a notice with the fewest edits in text[lo:hi], the first of those, as (edits, start, end, lo, hi); or none."""
        m = self.patterns[which].search(text, lo, hi) if hi - lo >= len(self.notices[which][1]) - self.notices[which][2] else None
        return [(sum(m.fuzzy_counts), m.start(), m.end(), lo, hi)] if m else []

    def matches(self, which: int, text: str, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of matches in the windows that don't overlap each other, those with fewest edits first.

        The windows' best matches wait in a heap. The least of all is taken, and its window goes on in front of it and behind it; one
        that overlaps a match already taken only divides its window. Windows are short, so work is in proportion to their number.
        """
        heap = [m for lo, hi in windows for m in self.best(which, text, lo, hi)]
        heapq.heapify(heap)
        taken, out = [], []
        while heap:
            edits, start, end, lo, hi = heapq.heappop(heap)
            k = bisect.bisect_left(taken, (start, start))
            over = next((t for t in taken[max(0, k - 1) : k + 1] if t[0] < end and t[1] > start), None)
            if over is None:
                over = (start, end)
                bisect.insort(taken, over)
                if end == len(text) or text[end] == " ":  # a window's end is not a word's end
                    out.append((start, end, edits))
            for part in ((lo, over[0]), (over[1], hi)):
                for m in self.best(which, text, *part):
                    heapq.heappush(heap, m)
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for which, at in uses:
                _, notice, k = self.notices[which]
                start = end - n + 1 - at - k
                lo, hi = max(0, start), start + len(notice) + 2 * k
                behind = text.find(" ", hi, hi + LONG_WORD)
                hi = behind if behind >= 0 else hi + LONG_WORD
                windows.setdefault(which, set()).add((lo, min(hi, len(text))))
        found = set()
        for which, own in windows.items():
            # Windows that overlap are joined while they stay short; each one stays whole, so every match lies in some window.
            joined: list[list[int]] = []
            for lo, hi in sorted(own):
                if joined and lo <= joined[-1][1] and hi - joined[-1][0] <= 3 * len(self.notices[which][1]):
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            for start, end, edits in self.matches(which, text, [(lo, hi) for lo, hi in joined]):
                found.add((self.notices[which][0], start, end, edits, len(self.notices[which][1])))
        return sorted(found, key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        flat = b" ".join(words).decode("latin-1")
        padded, base = f" {flat} ", []
        for phrase, label in BASE.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                base.append((label, at, at + len(phrase)))
                at = padded.find(f" {phrase} ", at + 1)
        fuzzy = self.fuzzy(flat)
        starts: list[int] = []
        if base or fuzzy:
            at = 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
        word = lambda at: bisect.bisect_right(starts, at) - 1
        spans = [(label, word(a), word(b - 1), a, b, 0) for label, a, b in base]
        spans += [(label, word(a), word(b - 1), a, b, e) for label, a, b, e, _ in fuzzy]
        at = [word(a) for _, a, _ in base]
        score = max([1.0 if base else 0.0, *(1 - e / n for *_, e, n in fuzzy)])
        labels = {label for label, *_ in base}
        both = labels | {label for label, *_ in fuzzy}
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), score, spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document with counts, labels and spans; spans' start and end are places in the text of folded words joined by spaces."""
    notices = notices or NOTICES
    names = SCHEMA.split(" spans")[0]

    def scan(batches):
        scanner = Scanner(notices)
        fields = ["doc_id", *(x.split()[0] for x in names.rstrip(", ").split(", ")[1:]), "spans"]
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)] + [[r[i] for r in rows] for i in range(7)] + [[[dict(zip(span.names, s)) for s in r[7]] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c.cast(k) for c, k in zip(cols, kinds)], names=fields)

    spark_in = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spark_in.mapInArrow(scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
