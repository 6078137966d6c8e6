import random
from collections import Counter, defaultdict

import pytest

from archgraph.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_sites, copies=frozenset()):
    """Texts without the lines of at least ``min_sites`` sites; lines of ``copies`` stay."""
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(BLANKS)].add(source)
    bad = {line for line, own in sites.items() if len(own) >= min_sites and line} - copies
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if line.strip(BLANKS) not in bad]
        out.append((doc_id, None if text is None else "\n".join(kept), sum(bool(x.strip(BLANKS)) for x in lines), len(lines) - len(kept)))
    return out


def corpus():
    draw = random.Random(4)
    unique = lambda: " ".join(f"u{draw.randrange(10**6)}" for _ in range(9))
    rows = []
    for i in range(240):
        lines = [unique() for _ in range(draw.randrange(1, 5))]
        for line, share, sites in (("Cookie notice here.", 0.5, 16), ("Rare footer", 0.3, 9), ("Ten sites only", 0.4, 10), ("Zwölf – Städte", 0.4, 12)):
            if draw.random() < share and i % 16 < sites:
                lines.insert(draw.randrange(len(lines) + 1), draw.choice(["", "  ", "\t"]) + line + draw.choice(["", " \r", " "]))
        rows.append((i, "\n".join([*lines, *draw.choice([[], [""], ["", "  "]])]), f"s{i % 16}"))
    copied = "\n".join(unique() for _ in range(4))
    return rows + [(1000 + i, copied, f"s{i % 16}") for i in range(40)], frozenset(copied.split("\n"))


@pytest.mark.parametrize("min_sites, sent", [(10, None), (3, None), (13, None), (10, 0)])
def test_lines_go_by_their_number_of_sites(make, monkeypatch, min_sites, sent):
    if sent is not None:
        monkeypatch.setattr(ld, "SENT_LINES", sent)
    rows, copies = corpus()
    found = ld.remove_boilerplate(make(rows), min_sites=min_sites).collect()
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found)
    assert got == sorted(brute(rows, min_sites, copies))


def test_copied_documents_stay_whole(make):
    rows, copies = corpus()
    found = {r.doc_id: r.text for r in ld.remove_boilerplate(make(rows)).collect()}
    assert all(found[1000 + i] == rows[240][1] for i in range(40))


def test_unsure_lines_are_counted_exactly(make, monkeypatch):
    rows, copies = corpus()
    expected = sorted(brute(rows, 10, copies))
    for unsure in (0.9, 0.1):
        monkeypatch.setattr(ld, "UNSURE", unsure)
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in ld.remove_boilerplate(make(rows)).collect()) == expected


def test_copies_do_not_outvote_independent_documents(make):
    words = lambda i: f"only document {i} has these words x{i} y{i}"
    rows = [(i, f"{words(i)}\nCommon footer", f"s{i % 20}") for i in range(100)]
    rows += [(1000 + i, f"{words(-1)}\nCommon footer", f"s{i % 20}") for i in range(400)]
    found = {r.doc_id: r.text for r in ld.remove_boilerplate(make(rows)).collect()}
    assert found == {i: text.split("\n")[0] for i, text, _ in rows}


def test_a_shared_passage_does_not_make_documents_copies(make):
    passage = [" ".join(f"p{line}w{i}" for i in range(40)) for line in range(6)]
    rows = [(i, "\n".join([f"short own text {i} here q{i}", *passage]), f"s{i % 20}") for i in range(60)]
    found = {r.doc_id: r.text for r in ld.remove_boilerplate(make(rows)).collect()}
    assert found == {i: text.split("\n")[0] for i, text, _ in rows}


def test_copies_are_one_document_on_one_site(make):
    own = lambda i: f"own text of group {i} g{i} h{i}"
    rows = [(100 * g + c, f"{own(g)}\nTen groups", f"s{c}") for g in range(10) for c in range(10)]
    rows += [(2000 + 100 * g + c, f"{own(50 + g)}\nNine groups", f"s{c}") for g in range(9) for c in range(20)]
    rows += [(5000 + c, f"{own(80)}\nOne site else", f"s{c}") for c in range(10)] + [(6000 + c, f"{own(90 + c)}\nOne site else", "s0") for c in range(20)]
    found = {r.doc_id: (r.text, r.n_removed) for r in ld.remove_boilerplate(make(rows)).collect()}
    gone = {i for i, (_, removed) in found.items() if removed}
    assert gone == {i for i, text, _ in rows if text.endswith("Ten groups")}


def test_odd_documents(odd, nothing, make):
    found = ld.remove_boilerplate(odd, min_sites=2, independent=0.0)
    assert found.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()) == Counter(brute(rows, 2))
    assert ld.remove_boilerplate(nothing).collect() == []
