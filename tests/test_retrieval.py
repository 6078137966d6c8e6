"""TF-IDF and dense search against plain Python, and what answers rest on."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from archgraph.functions.stopwords import ENGLISH
from archgraph.operators.tfidf import fit_tfidf, search, search_dense, search_documents
from archgraph.operators.topk import top_k
from archgraph.plans.ask import (
    Answers, answer_context, build_prompts, compute_confidence, evidence_blocks, index_symbols,
)
from archgraph.session import materialize
from tests.conftest import call

WORDS = "alpha beta gamma delta été naïve order_id x2 the and payment refund ledger cart".split()


def corpus(seed, n=40):
    dice = random.Random(seed)
    return [(dice.choice(["one", "two"]), f"d{i:02d}", " ".join(dice.choices(WORDS, k=dice.randrange(0, 12))).title())
            for i in range(n)]


def tokens(text):
    return [t for t in re.findall(r"\w\w+", text.lower()) if t not in ENGLISH]


def brute_index(docs, limit):
    """repo -> (idf, doc -> unit vector)"""
    index = {}
    for repo in {r for r, _, _ in docs}:
        own = {d: Counter(tokens(t)) for r, d, t in docs if r == repo}
        total = sum(own.values(), Counter())
        terms = sorted(total, key=lambda t: (-total[t], t))[:limit]
        df = {t: sum(t in c for c in own.values()) for t in terms}
        idf = {t: math.log((1 + len(own)) / (1 + df[t])) + 1 for t in terms}
        index[repo] = idf, {d: unit(c, idf) for d, c in own.items()}
    return index


def unit(counts, idf):
    raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
    length = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / length for t, w in raw.items()}


@pytest.mark.parametrize("limit, pad", [(4096, False), (4096, True), (3, True)])
def test_search_matches_brute_force(tables, limit, pad):
    docs = corpus(3)
    questions = [("q1", "one", "Where is the payment LEDGER?"), ("q2", "two", "refund refund été"),
                 ("q3", "one", "zzz unknown"), ("q4", "two", "the and"), ("q5", "absent", "payment")]
    index = fit_tfidf(tables.rows("repo_id string, doc_id string, text string", *docs), limit)
    asked = tables.rows("query_id string, repo_id string, question string", *questions)
    found = defaultdict(list)
    for r in search(asked, index, 5, pad).orderBy("rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    expected = defaultdict(list)
    brute = brute_index(docs, limit)
    for q, repo, text in questions:
        if repo in brute:
            idf, vectors = brute[repo]
            query = unit(Counter(tokens(text)), idf)
            scores = {d: round(sum(w * query.get(t, 0) for t, w in v.items()), 6) for d, v in vectors.items()}
            kept = {d: s for d, s in scores.items() if pad or set(vectors[d]) & set(query)}
            best = sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:5]
            if best:
                expected[q] = best
    assert {q: [d for d, _ in hits] for q, hits in found.items()} == {
        q: [d for d, _ in hits] for q, hits in expected.items()}
    for q in expected:
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in expected[q]], abs=2e-6)


def test_vocabulary_ties_go_by_term(tables):
    docs = tables.rows("repo_id string, doc_id string, text string", ("r", "a", "bb aa cc"), ("r", "b", "cc dd"))
    assert {r.term for r in fit_tfidf(docs, 2).vocabulary.collect()} == {"cc", "aa"}


def test_documents_of_symbols(tables):
    symbols = tables.symbols(
        {"symbol_type": "method", "id": "m.A.f", "decorators": ["@x", "@y"], "docstring": '"""Hi."""'},
        {"symbol_type": "import", "id": "i"}, {"symbol_type": "class", "id": "m.A"},
        {"symbol_type": "file", "id": "e", "qualified_name": " ", "name": "e"})
    docs = {r.symbol_uid: (r.doc_id, r.text) for r in search_documents(symbols).collect()}
    assert docs == {"r:m.A.f": ("src/a.py#00000000", 'm.A.f\n@x @y\n"""Hi."""'), "r:m.A": ("src/a.py#00000002", "m.A")}


@pytest.mark.parametrize("blocks", [(20_000, 500), (20_000, 500, 0), (7, 2, 4)])
def test_dense_search_matches_brute_force(tables, blocks):
    dice = np.random.default_rng(5)
    vectors = np.round(dice.normal(size=(60, 8)), 2)
    vectors[3] = 0
    queries = np.vstack([np.round(dice.normal(size=(4, 8)), 2), np.zeros(8)])
    found = search_dense(
        tables.rows("query_id long, repo_id string, embedding array<double>",
                    *[(i, "r", q.tolist()) for i, q in enumerate(queries)]),
        tables.rows("repo_id string, vec_id long, embedding array<float>",
                    *[("r", i, v.tolist()) for i, v in enumerate(vectors)]), 5, *blocks).collect()

    def scaled(m):
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(length > 0, m / np.where(length > 0, length, 1), 0)

    exact = np.round(scaled(queries) @ scaled(vectors.astype(np.float32).astype(float)).T, 6)
    for i, row in enumerate(exact):
        expected = sorted(range(60), key=lambda j: (-row[j], j))[:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == i] == expected


def test_confidence(tables):
    questions = tables.rows("query_id string, repo_id string, question string",
                            *[(q, "r", "?") for q in ("strong", "weak", "bare", "none", "full")])
    hits = tables.rows("query_id string, repo_id string, score double, rank int",
                       ("strong", "r", 0.6, 1), ("strong", "r", 0.3, 2), ("strong", "r", 0.3, 3), ("strong", "r", 0.0, 4),
                       ("weak", "r", 0.3, 1), ("bare", "r", 0.2, 1), ("bare", "r", 0.1, 2), ("full", "r", 0.95, 1))
    evidence = tables.rows("query_id string, repo_id string, related array<struct<confidence: double>>",
                           ("strong", "r", [(0.3,), (0.7,)]), ("weak", "r", [(0.69,)]), ("weak", "r", []),
                           ("bare", "r", []), ("full", "r", [(1.0,)]))
    rows = {r.query_id: (round(r.confidence_score, 6), r.confidence_label)
            for r in compute_confidence(questions, hits, evidence).collect()}
    assert rows == {"strong": (0.6, "Confirmed"), "weak": (0.35, "Inferred"), "bare": (0.15, "Uncertain"),
                    "none": (0.0, "Uncertain"), "full": (1.0, "Confirmed")}


@pytest.fixture(scope="module")
def answers(tables) -> Answers:
    symbols = [("file", "shop"), {"symbol_type": "function", "id": "shop.refund", "docstring": "'Refund a payment.'"},
               ("function", "shop.audit"), ("function", "shop.ship")]
    rows = [call("shop.audit", "shop.refund", 4), call("shop", "shop.refund", 1, "contains", confidence=1.0)]
    graph = tables.graph(symbols, rows)
    questions = tables.rows("query_id string, repo_id string, question string",
                            ("q", "r", "who does refund?"), ("far", "nowhere", "refund"))
    return answer_context(questions, index_symbols(tables.symbols(*symbols)), graph)


def test_answer_context(answers):
    best = answers.evidence.filter("query_id = 'q' and rank = 1").first()
    assert best.qualified_name == "shop.refund"
    assert [(r.direction, r.qualified_name) for r in best.related] == [("incoming", "shop.audit")]
    scores = {r.query_id: r for r in answers.confidence.collect()}
    assert scores["far"].confidence_score == 0 and scores["q"].confidence_score > 0.2
    assert answers.evidence.filter("query_id = 'q'").count() == 4


def test_prompt_text(answers):
    prompts = {r.query_id: r for r in answers.prompts.collect()}
    assert prompts["far"].evidence_block == "Nothing in the repository matches the question."
    block = prompts["q"].evidence_block
    assert block.startswith("1. function shop.refund, src/a.py lines 1 to 2\n"
                            "   incoming CALLS shop.audit at src/a.py:1, 0.75\n\n2. ")
    assert "no edges" in block
    system, user = prompts["q"].messages
    assert (system.role, user.role) == ("system", "user")
    assert "<question>who does refund?</question>" in user.content and block in user.content


def test_blocks_without_evidence(tables):
    questions = tables.rows("query_id string, repo_id string, question string", ("q", "r", "?"))
    empty = tables.rows("query_id string, repo_id string, rank int, symbol_type string, qualified_name string, "
                        "file_path string, start_line int, end_line int, related array<struct<relationship_type: string, "
                        "direction: string, qualified_name: string, file_path: string, start_line: int, confidence: double>>")
    assert build_prompts(evidence_blocks(questions, empty)).first().evidence_block.startswith("Nothing in the repository")


def test_blocks_that_cannot_hold_a_hit_are_not_scored(spark, tables, monkeypatch):
    """Rows of the scoring step against all pairs with a common term; the hits are the same."""
    from archgraph.operators import tfidf

    dice = np.random.default_rng(11)
    common = [f"common{i}" for i in range(30)]
    docs = tables.rows("repo_id string, doc_id string, text string", *[
        ("r", f"module{i // 40:03}#{i:05}", " ".join([*dice.choice(common, 12), *(f"topic{i // 40}x{j}" for j in dice.integers(0, 25, 8))])) for i in range(2000)])
    questions = tables.rows("query_id string, repo_id string, question string", *[
        (f"q{q}", "r", f"common1 common2 common3 common4 topic{q}x1 topic{q}x2 topic{q}x3 topic{q}x4") for q in range(20)])
    index = fit_tfidf(docs)
    asked = tfidf.question_weights(questions, index.vocabulary)
    kept = materialize(tfidf.best_scores(asked, index, 5), "kept")
    every = materialize(index.weights.join(asked, ["repo_id", "term"]).groupBy("query_id", "repo_id", "doc_id").agg(
        tfidf._products("weight").alias("score")), "every")
    assert kept.count() < every.count() / 4
    order = [F.col("score").desc(), F.col("doc_id")]
    ids = ["query_id", "rank", "doc_id", "score"]
    assert top_k(kept, ["query_id"], order, 5).select(*ids).exceptAll(top_k(every, ["query_id"], order, 5).select(*ids)).isEmpty()


@pytest.mark.parametrize("blocks", [(20_000, 500), (7, 2, 0)])
def test_dense_search_takes_whatever_the_store_got(tables, blocks):
    nan, inf = float("nan"), float("inf")
    vectors = tables.rows("repo_id string, vec_id long, embedding array<float>", ("r", 1, [1.0, 0.0]), ("r", 2, None), ("r", 3, []), ("r", 4, [1.0, None]),
                          ("r", 5, [nan, 1.0]), ("r", 6, [inf, 1.0]), ("r", 7, [1.0, 0.0, 0.0]), ("r", 8, [0.0, 0.0]), ("r", 9, [0.6, 0.8]), ("s", 1, [1.0, 0.0]))
    queries = tables.rows("query_id long, repo_id string, embedding array<double>", (1, "r", [2.0, 0.0]), (2, "r", [0.0, 0.0, 3.0]), (3, "r", None), (4, "r", [nan, 0.0]),
                          (5, "r", [1.0]), (6, "none", [1.0, 0.0]))
    found = search_dense(queries, vectors, 5, *blocks).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in found) == [(1, 1, 1, 1.0), (1, 2, 9, 0.6), (1, 3, 8, 0.0), (2, 1, 7, 0.0)]


@pytest.mark.parametrize("pad", [False, True])
def test_rows_of_the_index_and_joins_give_the_same_hits(tables, monkeypatch, pad):
    """Long texts that fill several rows, ids that repeat or are null, ties, and questions without an id."""
    from archgraph.operators import tfidf

    dice = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    long = [("r", i, " ".join(dice.choice(words, 40_000))) for i in (1, 2, 3)]
    docs = [*long, *[("r", 10 + i % 50, " ".join(dice.choice(words, 6))) for i in range(90)], ("r", None, "w1 w2"), ("r", None, "w1"), ("s", 1, "w1 w1 w2"), ("s", 2, None)]
    questions = [("a", "r", "w1 w2 w3 w4"), ("b", "r", "w5"), (None, "r", "w7 w8"), ("a", "s", "w1"), ("d", "s", "nothing")]
    index = fit_tfidf(tables.rows("repo_id string, doc_id long, text string", *docs))
    asked = tables.rows("query_id string, repo_id string, question string", *questions)
    assert index.rows.filter("repo_id = 'r'").count() > 1
    whole = index.weights.groupBy("repo_id", "doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("one")).collect()
    assert {r.doc_id for r in whole if r.repo_id == "r"} == {d for r, d, _ in docs if r == "r" and d is not None}
    assert [r.one for r in whole] == pytest.approx([1.0] * len(whole), abs=1e-6)
    assert "Exchange" not in tfidf._best_of_rows(tfidf.question_weights(asked, index.vocabulary), index, 4)._jdf.queryExecution().executedPlan().toString()
    ways = []
    for sent in (tfidf.ASKED_SENT, 0):
        monkeypatch.setattr(tfidf, "ASKED_SENT", sent)
        ways.append(sorted(map(tuple, search(asked, index, 4, pad).collect()), key=repr))
    assert ways[0] == ways[1] and len(ways[0]) >= 9


def test_rows_of_the_index_are_packed_and_the_commonest_terms_are_sent(spark, tables, monkeypatch):
    """A posting takes few bytes in the written index; however many terms are sent, the weights are the same to the last bit."""
    from archgraph.operators import tfidf

    dice = np.random.default_rng(17)
    texts = [" ".join(f"wörd{w}" for w in (4_000 * dice.random(400) ** 3).astype(int)) for _ in range(400)]
    docs = tables.rows("repo_id string, doc_id long, text string", *[(r, i, t) for i, t in enumerate(texts) for r in (["r", "s"] if i < 40 else ["r"])], (None, 1, "lost"))
    written = []
    for sent in (tfidf.TERMS_SENT, 3_000, 0):
        monkeypatch.setattr(tfidf, "TERMS_SENT", sent)
        index = fit_tfidf(docs)
        common, rest = tfidf._sent_terms(materialize(index.vocabulary.withColumn("parts", F.col("df")), "vocabulary"))
        assert sum(map(len, common.values())) + rest.count() == index.vocabulary.count() and sum(map(len, common.values())) <= sent
        written.append(sorted(map(tuple, index.weights.drop("block").collect())))
    assert written[0] == written[1] == written[2]
    assert {r[0] for r in written[0]} == {"r", "s"}
    schema = dict(index.rows.dtypes)
    assert not {"weights", "terms"} & set(schema) and "array<string>" not in schema.values()
    packed = index.rows.select(F.sum(sum(F.length(c) for c, kind in schema.items() if kind == "binary")).alias("bytes")).first().bytes
    assert packed < 8 * len(written[0])


def test_rows_of_the_index_go_to_python_a_few_at_a_time(spark, tables, monkeypatch):
    from archgraph.operators import tfidf

    index = fit_tfidf(tables.rows("repo_id string, doc_id long, text string", ("r", 1, "payment ledger")))
    asked = tables.rows("query_id string, repo_id string, question string", ("q", "r", "ledger"))
    seen, plain = [], tfidf._best_of_rows
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(tfidf, "_best_of_rows", lambda *a: seen.append(int(spark.conf.get(name))) or plain(*a))
    before = spark.conf.get(name)
    assert search(asked, index).count() == 1
    assert seen == [tfidf.BATCH_BYTES] and spark.conf.get(name) == before
