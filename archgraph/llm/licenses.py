"""Licence notices in texts: fixed phrases, and templates compiled to token automata.

A template is a line of words with markup: ``[...]`` may be left out,
``{low-high}`` stands for any words of that number, ``a|b`` for either word.
The compiled automaton accepts a run of words exactly if all mandatory wording
is there in order, with nothing between but what the template allows.

Words are runs of letters A-Z (lower-cased), digits and all characters beyond
ASCII; everything else parts words. Null and empty texts have no words and no
places. Repeated rows are scanned each by itself. Result columns replace input
columns of the same name.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.sized import bounded_batches
from archgraph.llm.text import LOWER, byte_table, hash_spans, row_offsets, spans, text_slices, word_counts

WORD_BYTES = byte_table((ord("0"), ord("9")), (ord("a"), ord("z")), (0x80, 0xFF))

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licence notices, with markup.
TEMPLATES = (
    ("mit", "[this] [work|software|project|program|code] [is] released|licensed|distributed|available under the [terms] [of] [the] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be "
            "included in all copies or substantial portions of the software"),
    ("apache-2.0", "[this] [work|software|project|program|file] [is] licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this [file|work|software] except in compliance with "
                   "the license you may obtain a copy of the license at {1-12} unless required by applicable law or agreed to in writing software "
                   "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "[this] [work|software|project|program] [is] licensed under the [terms] [of] [the] gnu general public license version 3 [0]"),
    ("gpl-3.0", "{0-8} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                "the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-3.0", "licensed under the [terms] [of] [the] gnu lesser general public license version 3 [0]"),
    ("agpl-3.0", "licensed under the [terms] [of] [the] gnu affero general public license version 3 [0]"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "[this] [work|text|page] [is] licensed under [a] [the] cc by nc 4 0"),
    ("cc-by-nc-4.0", "licensed under [a] [the] creative commons attribution noncommercial 4 0 international [public] license"),
    ("cc-by-4.0", "licensed under [a] [the] cc by 4 0"),
    ("cc-by-4.0", "licensed under [a] [the] creative commons attribution 4 0 international [public] license"),
    ("cc-by-sa-4.0", "licensed under [a] [the] cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Automaton:
    """States are positions in the template; ``steps`` has per state the words that lead on, ``skips`` the states reachable without a word."""

    label: str
    steps: tuple
    skips: tuple
    anchor: tuple
    lead: int

    def longest(self, words, begin, end):
        """The end of the longest run of words from ``begin`` that is accepted, or -1."""
        found, states = -1, self.closed({0})
        last = len(self.steps)
        at = begin
        while states:
            if last in states:
                found = at
            if at == end:
                break
            word = words(at)
            states = self.closed({s + 1 for s in states if s < last and (self.steps[s] is None or word in self.steps[s])})
            at += 1
        return found

    def closed(self, states):
        todo = list(states)
        while todo:
            for onward in self.skips[todo.pop()]:
                if onward not in states:
                    states.add(onward)
                    todo.append(onward)
        return states


def compile_template(label, markup):
    """The automaton of a template, anchored at its longest run of mandatory single words."""
    steps, skips, mandatory, open_at = [], {}, [], None
    for token in markup.replace("[", " [ ").replace("]", " ] ").split():
        if token == "[":
            open_at = len(steps)
        elif token == "]":
            skips.setdefault(open_at, []).append(len(steps))
            open_at = None
        elif token.startswith("{"):
            low, high = map(int, token.strip("{}").split("-"))
            for number in range(high):
                if number >= low:
                    skips.setdefault(len(steps), []).append(len(steps) + 1)
                steps.append(None)
                mandatory.append(None)
        else:
            choices = frozenset(token.split("|"))
            steps.append(choices)
            mandatory.append(next(iter(choices)) if len(choices) == 1 and open_at is None else None)
    runs, begin = [(0, 0)], None
    for at, word in enumerate([*mandatory, None]):
        if word is not None and begin is None:
            begin = at
        elif word is None and begin is not None:
            runs.append((at - begin, begin))
            begin = None
    length, lead = max(runs, key=lambda run: (run[0], -run[1]))
    anchor = tuple(mandatory[lead : lead + length])
    return Automaton(label, tuple(steps), tuple(tuple(skips.get(i, ())) for i in range(len(steps) + 1)), anchor, lead)


def _word_hashes(words):
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return hash_spans(data, ends - [len(w.encode()) for w in words], ends)


def _places(hashes, row, phrase):
    """Starts of consecutive words of one row that are the phrase."""
    size = len(phrase)
    if len(hashes) < size:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(hashes[: len(hashes) - size + 1] == phrase[0])
    for step in range(1, size):
        at = at[hashes[at + step] == phrase[step]]
    return at[row[at] == row[at + size - 1]]


def license_places(docs, keep=("doc_id",), text="text", phrases=PHRASES, templates=TEMPLATES):
    """``keep`` columns, ``n_words``, and ``places``: label, kind (phrase or template), first word and the word after the last."""
    bounded_batches(docs.sparkSession)
    automata = [compile_template(*template) for template in templates]
    fixed = [(label, _word_hashes(phrase.split())) for phrase, label in phrases]
    anchors = [_word_hashes(automaton.anchor) for automaton in automata]
    own = ("n_words", "places")
    kept = [name for name in keep if name not in own]
    rows = docs.select(*[F.col(f"`{name}`").alias(name) for name in kept], F.col(f"`{text}`").alias("scanned text"))
    place = T.StructType.fromDDL("label string, kind string, first long, after long")
    schema = T.StructType([*(rows.schema[n] for n in kept), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place))])
    arrow_place = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("after", pa.int64())])

    def scan(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("scanned text")):
                data = LOWER[data]
                start, end, row = spans(data, offsets, WORD_BYTES)
                hashes = hash_spans(data, start, end)
                many = len(offsets) - 1
                counts = word_counts(row, many)
                begin = row_offsets(counts)
                found = [[] for _ in range(many)]
                for label, phrase in fixed:
                    for at in _places(hashes, row, phrase).tolist():
                        own_row = int(row[at])
                        found[own_row].append((label, "phrase", at - int(begin[own_row]), at - int(begin[own_row]) + len(phrase)))
                raw = data.tobytes()

                def word(at):
                    return raw[start[at] : end[at]].decode()

                for automaton, anchor in zip(automata, anchors):
                    seen = {}
                    for at in _places(hashes, row, anchor).tolist():
                        own_row = int(row[at])
                        low, high = int(begin[own_row]), int(begin[own_row + 1])
                        for one in range(max(low, at - automaton.lead), at + 1):
                            if one in seen:
                                break
                            stop = automaton.longest(word, one, high)
                            if stop > at:
                                seen[one] = True
                                found[own_row].append((automaton.label, "template", one - low, stop - low))
                                break
                listed = [[dict(zip(("label", "kind", "first", "after"), p)) for p in places] for places in found]
                kept_columns = [batch.column(i).slice(first, many) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(counts, pa.int64()), pa.array(listed, pa.list_(arrow_place))], names=schema.fieldNames())

    return rows.mapInArrow(scan, schema)


def license_summary(scanned):
    """Digest of ``license_places``: base places, labels, and the share of words inside any place."""
    base = F.filter("places", lambda p: p["kind"] == "phrase")
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    ordered = F.array_sort(F.transform("places", lambda p: F.struct(p["first"].alias("first"), p["after"].alias("after"))))
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("covered"))
    covered = F.aggregate(
        ordered, start,
        lambda a, p: F.struct(
            F.greatest(a["reach"], p["after"]).alias("reach"),
            (a["covered"] + F.greatest(F.lit(0).cast("long"), p["after"] - F.greatest(a["reach"], p["first"]))).alias("covered"),
        ),
        lambda a: a["covered"],
    )
    return scanned.select(
        *[c for c in scanned.columns if c != "places"],
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"),
        joined(base).alias("base_labels"), joined("places").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
