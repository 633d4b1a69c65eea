"""License scans: exact phrases, and a fuzzy search for short notices.

A text becomes its words in lower case, joined by single blanks.  A *phrase* stands where its words stand consecutively.  A
*notice* stands where a run of whole words is at most so many edits of characters (one for every ``chars_per_edit``) from it.
If a notice with e edits is cut into e + 1 seeds, one of them stands unchanged in every such run (pigeonhole), so one
automaton of all phrases and seeds finds all candidates in a single pass; the stretch around a seed, as wide as the edits
allow, goes to the regex library's bounded-error matching, which tells the edits and the span.  Of the overlapping runs
of a notice in one stretch the one with the fewest edits is reported, then the first.

Everything happens within the row, with no shuffle; the automaton is built once in each Python worker from constants.  A
null or empty text has no words and no places.  Very long texts are searched whole; stretches are of bounded length, and
places take memory in proportion to the text.  Repeated rows give repeated results, an empty table an empty one, and
columns of ``docs`` other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import ascii_words, utf8, whole_text

# Phrases and notices of licenses, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)

PLACES = "array<struct<label: string, exact: boolean, edits: int, size: int, first_word: long, last_word: long, start: long, end: long, found: string>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("edits", pa.int32()), ("size", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Settings:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES
    chars_per_edit: int = 15

    def edits(self, notice: str) -> int:
        return len(notice) // self.chars_per_edit


class Finder:
    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        keys: dict[str, list[tuple]] = {}
        for phrase, label in settings.phrases:
            keys.setdefault(f" {phrase} ", []).append((label, len(phrase)))
        self.patterns = []
        for k, (notice, _) in enumerate(settings.notices):
            edits = settings.edits(notice)
            self.patterns.append(regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={edits}}}(?= )"))
            cuts = [len(notice) * c // (edits + 1) for c in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                keys.setdefault(notice[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for key, uses in keys.items():
            self.automaton.add_word(key, (len(key), uses))
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple]:
        """(label, exact, edits, size, start, end) in ``text``: words within single blanks, one before and one after."""
        out, stretches = [], {}
        for end, (size, uses) in self.automaton.iter(text):
            start = end + 1 - size
            for what, at in uses:
                if isinstance(what, str):
                    out.append((what, True, 0, at, start + 1, end))
                else:
                    stretches.setdefault(what, []).append(start - at)
        for k, starts in stretches.items():
            out += self._notices(text, k, starts)
        return out

    def _notices(self, text: str, k: int, starts: list[int]) -> Iterator[tuple]:
        notice, label = self.settings.notices[k]
        edits = self.settings.edits(notice)
        done = 0
        for at in sorted(set(starts)):
            begin, end = max(0, at - edits - 1, done), min(len(text), at + len(notice) + edits + 1)
            if begin < end and (found := self.patterns[k].search(text, begin, end)):
                yield label, False, sum(found.fuzzy_counts), len(notice), found.start(), found.end()
                done = found.end()


@cache
def _finder(settings: Settings) -> Finder:
    return Finder(settings)


def _scan_batches(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(settings)
        for batch in batches:
            counts, places = [], []
            for raw in utf8(batch.column("text")):
                words = ascii_words(raw)
                counts.append(len(words))
                text = f" {b' '.join(words).decode()} "
                found = finder.places(text)
                places.append(_located(found, text, raw.decode()) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, _PLACES)], ["doc_id", "n_words", "places"])

    return run


def _located(found: list[tuple], text: str, whole: str) -> list[dict]:
    """Places by word and by character of the whole text."""
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    spans = [m.span() for m in _WORD.finditer(whole)]
    out = []
    for label, exact, edits, size, start, end in found:
        first, last = int(np.searchsorted(blanks, start)) - 1, int(np.searchsorted(blanks, end)) - 1
        a, b = spans[first][0], spans[last][1]
        out.append({"label": label, "exact": exact, "edits": edits, "size": size, "first_word": first, "last_word": last, "start": a, "end": b, "found": whole[a:b]})
    return out


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words and the places found.

    A place has its label, whether it is an exact phrase, the edits against the notice and its size in characters, the first
    and the last word (from 0), and the span of characters in the text with what stands there.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(_scan_batches(settings), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, places {PLACES}")


def license_scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases, and first_word and last_word are the least and the largest word at which one
    begins.  base_labels are of phrases, labels of notices too.  The score is 1 for a phrase, else the largest share of a
    notice's characters that needed no edit, 0 without places.
    """
    base = F.filter("places", lambda p: p.exact)
    starts = F.transform(base, lambda p: p.first_word)

    def listed(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    share = F.array_max(F.transform("places", lambda p: 1 - p.edits / p["size"]))
    return scan(docs, settings).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("places")).alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"),
    )
