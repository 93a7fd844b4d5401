"""License scans by a positional index of rare words.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. Each template is a sequence of words: a sentence of a licence's
notice, its title, or an SPDX tag. Inverse document frequencies of the templates' words come from all scanned documents, in a pass before. The
index holds, for each template, the places of its ANCHORS words of highest IDF, and of the rarest word of each key phrase.
A file's words are looked up there; a posting at template place p for the file's word i votes for an alignment
of the template at i - p, and postings are intersected by that relative position (within SLACK words, since notices vary).
Where enough anchors agree, all of the template's words are compared at their places, and the licence is reported if one of its
mandatory key phrases stands there consecutively and the matched share of the template's IDF is LEAST or more.

Besides, the base phrases count wherever their words stand consecutively, and their labels are always reported. The score is the
best matched share, and 1 where a base phrase stands. Null and empty texts have no words, no labels, nulls for places, and score 0. Words
of equal IDF rank by code point. Rows that repeat are scanned alike, very long texts whole; an empty table gives no rows; columns are found by
position, so names that clash do no harm. Building the result runs the pass that counts words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quernal.llm.common import packed, tidied

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, notice, mandatory key phrases (one of them must stand within the notice).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["hereby granted free of charge", "any person obtaining a copy"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license", "gnu gpl"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license", "library general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license", "bsd 3 clause", "bsd 2 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4", "creative commons attribution 3", "creative commons attribution international"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4", "cc by 3", "cc by 2"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa", "attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc", "attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd", "attribution noderivatives"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0", "cc0 universal"]),
    ("isc", "isc license", ["isc license"]),
    ("mpl", "mozilla public license version 2 0", ["mozilla public license"]),
    ("epl", "eclipse public license version 2 0", ["eclipse public license"]),
    ("gpl", "gnu gpl version 3", ["gnu gpl"]),
    ("gpl", "gplv2", ["gplv2"]),
    ("gpl", "gplv3", ["gplv3"]),
    ("lgpl", "lgplv3", ["lgplv3"]),
    ("agpl", "agplv3", ["agplv3"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsl", "boost software license version 1 0", ["boost software license"]),
    ("zlib", "zlib license", ["zlib license"]),
    ("artistic", "artistic license 2 0", ["artistic license"]),
    ("unlicense", "released under the unlicense", ["the unlicense"]),
]

# Label, and the words of SPDX identifiers that it covers.
SPDX = {
    "mit": ["mit"], "apache": ["apache 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"],
    "bsd": ["bsd 2 clause", "bsd 3 clause"], "isc": ["isc"], "mpl": ["mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"], "unlicense": ["unlicense"],
    "cc0": ["cc0 1 0"], "cc-by": ["cc by 3 0", "cc by 4 0"], "cc-by-sa": ["cc by sa 3 0", "cc by sa 4 0"], "bsl": ["bsl 1 0"], "zlib": ["zlib"],
}
TEMPLATES = NOTICES + [(label, f"spdx license identifier {x}", [f"identifier {x}"]) for label, ids in SPDX.items() for x in ids]

ANCHORS, SLACK, LEAST = 4, 3, 0.5

#: Upper case to lower, and what is in no word to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    weight: float
    anchors: int


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float


class Index:
    """Templates, the IDF of their words, and the postings of their rarest ones.

    seen: in how many of n documents each word stands; without it, templates are the documents.
    """

    def __init__(self, templates=TEMPLATES, base=BASE, seen: dict[bytes, int] | None = None, n: int = 0):
        words = [x.encode().split() for _, x, _ in templates]
        if seen is None:
            seen, n = Counter(w for x in words for w in set(x)), len(words)
        self.vocabulary = frozenset(w for x in words for w in x)
        self.idf = {w: math.log(1 + (n + 1) / (seen.get(w, 0) + 1)) for w in self.vocabulary}
        self.templates: list[Template] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ((label, _, keys), x) in enumerate(zip(templates, words, strict=True)):
            rank = lambda w: (-self.idf.get(w, 0.0), w)
            rare = set(sorted(set(x), key=rank)[:ANCHORS])
            # The rarest word of each key phrase is looked up too, so that no notice is missed for other words beside its phrase.
            rare |= {min(k.encode().split(), key=rank) for k in keys} & set(x)
            for i, w in enumerate(x):
                if w in rare:
                    self.postings[w].append((t, i))
            self.templates.append(Template(label, x, [k.encode().split() for k in keys], sum(self.idf[w] for w in x), min(2, len(rare))))
        self.base: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for phrase, label in base.items():
            x = phrase.encode().split()
            self.base[x[-1]].append((x, label))
        self.looked_up = frozenset(self.postings) | frozenset(self.base)

    def scan(self, text: str | None) -> Scan:
        words = words_of(text)
        if self.looked_up.isdisjoint(words):
            return Scan(len(words), 0, None, None, "", "", 0.0)
        starts: list[int] = []
        base, labels, score = set(), set(), 0.0
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for i, w in enumerate(words):
            if w in self.looked_up:
                for phrase, label in self.base.get(w, ()):
                    k = i + 1 - len(phrase)
                    if k >= 0 and words[k : i + 1] == phrase:
                        starts.append(k)
                        base.add(label)
                for t, p in self.postings.get(w, ()):
                    votes[t, i - p].add(w)
        seen: set[tuple[int, int]] = set()
        for (t, at), mine in votes.items():
            if (t, at) in seen:
                continue
            x = self.templates[t]
            agree = set(mine).union(*(votes.get((t, at + d), ()) for d in range(-SLACK, SLACK + 1)))
            if len(agree) < x.anchors:
                continue
            share = self._matched(words, at, x)
            if share >= LEAST and self._has_key(words, at, x):
                labels.add(x.label)
                score = max(score, share)
        if starts:
            score = 1.0
        return Scan(len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), min(1.0, score))

    def _matched(self, words: list[bytes], at: int, x: Template) -> float:
        """The share of the template's IDF whose words stand at their places, or up to SLACK words beside."""
        got = 0.0
        for p, w in enumerate(x.words):
            lo = max(0, at + p - SLACK)
            if w in words[lo : max(lo, at + p + SLACK + 1)]:
                got += self.idf[w]
        return got / x.weight

    def _has_key(self, words: list[bytes], at: int, x: Template) -> bool:
        lo = max(0, at - SLACK)
        near = words[lo : max(lo, at + len(x.words) + SLACK + 1)]
        return any(near[i : i + len(k)] == k for k in x.keys for i in range(len(near) - len(k) + 1))


@tidied
def _counted(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many texts of a partition each word of the vocabulary stands; the empty word counts the texts."""
    seen: Counter[bytes] = Counter()
    for b in batches:
        seen[b""] += b.num_rows
        for text in b.column("text"):
            seen.update(vocabulary.intersection(words_of(text.as_py())))
    words, counts = list(seen), list(seen.values())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])


@tidied
def _scanned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    for b in batches:
        got = [index.scan(t.as_py()) for t in b.column("text")]
        cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", *Scan._fields])


def index_for(rows: DataFrame) -> Index:
    """The index with document frequencies of rows (text). What the driver gets is a count for each of the templates' words."""
    vocabulary = Index().vocabulary
    counts = rows.select("text").mapInArrow(lambda it: _counted(it, vocabulary), "word binary, n long").groupBy("word").sum("n").collect()
    seen = {bytes(w): n for w, n in counts}
    return Index(seen=seen, n=seen.get(b"", 0))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = packed(df, id=id_col, text=text_col).select("id", "text")
    held = df.sparkSession.sparkContext.broadcast(index_for(rows))
    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "id")
    out = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(lambda it: _scanned(it, held.value), out)
