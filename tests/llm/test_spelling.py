import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archgraph.llm import spelling
from archgraph.llm.spelling import Index, Strings, near_counts, roots, spelling_variants, words_of
from archgraph.llm.text import text_slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(doc_id, text):
    for run in RUN.findall(text or ""):
        run = run.translate(LOW)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 97 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= 5:
            yield run


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(counts):
    out = {}
    for word, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(word, o)]
        out[word] = (n, len(others), min(others)[::-1] if others else None)
    return out


def brute(docs, least=3):
    counts = Counter(w for doc, text in docs for w in words(doc, text))
    counts = {w: n for w, n in counts.items() if n >= least}
    found = brute_near(counts)
    form = {w: best[0] if best and -best[1] >= 2 * n else None for w, (n, _, best) in found.items()}
    rows = []
    for w, (n, many, _) in found.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, many, counts[form[w]] if form[w] else None))
    return sorted(rows)


def rows(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


LETTERS = st.text(alphabet="abcé", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.sets(LETTERS, min_size=1, max_size=40))
def test_one_error_after_an_exact_half(vocabulary):
    listed = sorted(vocabulary)
    strings = Strings(pa.array(listed))
    index = Index(strings, np.arange(len(listed)))
    for exact in (strings.length // 2, (strings.length + 1) // 2):
        one, word = index.one_error(strings, np.arange(len(listed)), exact)
        pairs = list(zip(one.tolist(), word.tolist()))
        assert len(pairs) == len(set(pairs))
        expected = {
            (i, j) for i, a in enumerate(listed) for j, b in enumerate(listed)
            if near(a, b) and b.endswith(a[len(a) - exact[i] :]) and any(near(a[: len(a) - exact[i]], b[: len(b) - exact[i]]) for _ in (0,))
        }
        assert set(pairs) == expected


@pytest.mark.parametrize("block_rows", [1 << 17, 3])
def test_counts_of_near_words(spark, block_rows):
    dice = np.random.default_rng(4)
    made = {"".join(dice.choice(list("abéd"), dice.integers(5, 9))) for _ in range(300)}
    made |= {"long" * 60 + tail for tail in ("", "x", "xy", "z")} | {"y" + "long" * 60}
    counts = {w: int(dice.integers(3, 9)) for w in made}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, (r.best.word, r.best.less) if r.best else None) for r in near_counts(table, block_rows).collect()}
    assert got == brute_near(counts)


def variants(dice, number):
    stems = ["spelling", "variant", "grouping", "éclairé", "maître", "straße", "letters"]
    for i in range(number):
        out = []
        for _ in range(dice.integers(3, 30)):
            word = stems[dice.integers(len(stems))]
            if dice.random() < 0.4:
                at = dice.integers(len(word))
                word = [word[:at] + word[at + 1 :], word[:at] + "xé"[dice.integers(2)] + word[at:], word[:at] + "q" + word[at + 1 :]][dice.integers(3)]
            out.append(word.capitalize() if dice.random() < 0.2 else word)
        yield i, " ".join(out) + ", don't × stop", "a"


def test_documents_with_variants(make):
    made = list(variants(np.random.default_rng(2), 150))
    made += [(3, made[0][1], "a"), (3, made[0][1], "a"), (None, made[1][1], "a")]
    assert rows(spelling_variants(make(made).repartition(4))) == brute([m[:2] for m in made])


def test_odd_documents(odd):
    assert rows(spelling_variants(odd, least=1)) == brute([(r.doc_id, r.text) for r in odd.collect()], 1)


def test_empty_table(nothing):
    assert spelling_variants(nothing).collect() == []


def test_a_text_longer_than_a_slice(make):
    text = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}uvwxyz{'abc'[i % 3] * (i % 4)}" for i in range(200_000))
    docs = [(1, text), (2, "a" * 100_000), (2, "a" * 100_000), (4, "a" * 100_000 + "é")]
    assert rows(spelling_variants(make([(i, t, "s") for i, t in docs]), least=1)) == brute(docs, 1)


def test_clashing_columns(make):
    clash = make([(1, "words words words wordz", "a")], ("word", "n", "place", "turned", "found_id"))
    assert rows(spelling_variants(clash)) == brute([(1, "words words words wordz")])


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("v", "w30")], "word string, form string")
    assert {r.word: r.root for r in roots(chain).collect()} == {f"w{i}": "w37" for i in range(37)} | {"v": "w37"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 10_000)), st.text(alphabet="abcdeXÀé÷ÿĀ1 ’\x01", max_size=60)), min_size=1, max_size=6))
def test_words_follow_the_rule(docs):
    got = Counter()
    column = pa.array([t for _, t in docs], pa.string())
    for first, data, offsets in text_slices(column):
        for word, n in zip(*words_of(data, offsets, [i for i, _ in docs][first:]).to_pydict().values()):
            got[word] += n
    assert got == Counter(w for i, t in docs for w in words(i, t))


def test_checksums_of_long_runs():
    texts = [b"", b"a", b"abc" * 30, b"x" * 64, b"y" * 65]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(b"7:")] * 5, dtype=np.uint32)
    assert spelling.checksums(begun, data, ends - [len(t) for t in texts], ends).tolist() == [zlib.crc32(b"7:" + t) for t in texts]
