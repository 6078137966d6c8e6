import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archgraph.llm.licenses import PHRASES, compile_template, license_places, license_summary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    words = words_of(text)
    return words, [(k, label) for phrase, label in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]


TEXTS = [
    "Released under the MIT License.", "under the MIT-License; under the mit license under\nthe mit\tlicense", "the MIT licensee",
    "Licensed under the Apache License, Version 2.0.", "Apache License Version 2", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License, version 2.",
    "École under the mit licensé", None, "", "under the mit", "license",
]


def test_base_places_and_labels(make):
    rows = license_summary(license_places(make([(i, t, "a") for i, t in enumerate(TEXTS)]))).collect()
    for r in rows:
        words, places = base_places(TEXTS[r.doc_id])
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[3] == "apache-2,apache-2.0" and labels[5] == "cc-by-nc,cc-by-nc-4.0" and labels[7] == "gpl-3.0" and labels[8] == ""
    assert labels[0] == "mit" and labels[4] == "apache-2"


def pattern(markup):
    """The same template as a regular expression over words, each followed by a blank."""
    out = []
    for token in markup.replace("[", " [ ").replace("]", " ] ").split():
        if token in "[]":
            out.append("(?:" if token == "[" else ")?")
        elif token.startswith("{"):
            out.append("(?:\\S+ ){%s}" % token.strip("{}").replace("-", ","))
        else:
            out.append(f"(?:{token}) ")
    return re.compile("".join(out))


MARKUP = st.lists(st.sampled_from(["a", "b", "c|d", "[a b]", "[c]", "{0-2}", "{1-2}"]), min_size=1, max_size=6).map(lambda t: " ".join([*t, "a"]))


@settings(max_examples=300, deadline=None)
@given(MARKUP, st.lists(st.sampled_from("abcd"), max_size=9))
def test_automata_accept_what_the_pattern_accepts(markup, words):
    automaton = compile_template("x", markup)
    expected = max((n for n in range(len(words) + 1) if pattern(markup).fullmatch("".join(f"{w} " for w in words[:n]))), default=-1)
    assert automaton.longest(words.__getitem__, 0, len(words)) == expected


def test_optional_and_replaceable_regions(make):
    templates = (("x", "[this] file is {1-3} free software [indeed] forever"),)
    texts = {
        1: "This file is really free software forever", 2: "file is a b c free software indeed forever.", 3: "file is free software forever",
        4: "file is a b c d free software forever", 5: "file is a free software indeed and forever", 6: "x " * 5000 + "file is a free software forever",
    }
    rows = license_places(make([(i, t, "a") for i, t in texts.items()]), templates=templates).collect()
    assert {r.doc_id: [(p["first"], p["after"]) for p in r.places] for r in rows} == {1: [(0, 7)], 2: [(0, 9)], 3: [], 4: [], 5: [], 6: [(5000, 5006)]}


@pytest.mark.parametrize("keep", [("doc_id",), ("doc_id", "row", "places", "n_words")])
def test_odd_documents(odd, nothing, keep):
    rows = license_summary(license_places(odd, keep=keep)).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((r.doc_id, len(words_of(r.text))) for r in odd.collect())
    assert license_summary(license_places(nothing)).collect() == []
