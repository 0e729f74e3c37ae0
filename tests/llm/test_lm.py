"""Language-model scores: counts and base score against plain Python, sums of probabilities, held-out texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from snapdelta.llm import lm, queries, wordtable
from snapdelta.llm.common import lower_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def plain(rows):
    c = Counter(t for doc, text in rows if not out(doc) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    result = []
    for doc, text in rows:
        found = tokens(text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        result.append((str(doc), out(doc), len(found), sum(c[t] > 0 for t in found), n, round(base, 6)))
    return sorted(result)


def found(rows):
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in rows)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


@pytest.mark.parametrize("rows", [[], [(0, "a b")], [(10, "only held out")], [(1, None), (1, ""), (2, None)]])
def test_few_rows(spark, make, rows):
    rows = [(next(i for i in range(100) if out(i)), t) if i == 10 else (i, t) for i, t in rows]
    assert found(lm.score_texts(make(rows)).collect()) == plain(rows)


def test_awkward_rows(spark, make, awkward):
    assert found(lm.score_texts(make(awkward), chunk_distinct=9, block_words=4).collect()) == plain(awkward)


def test_query(spark, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert found(queries.QUERIES["op4_lm_scores"](spark, sf_dir).collect()) == plain([(r["doc_id"], r["text"]) for r in stored])


CAT = [(i, "the cat sat on a mat while one dog ran " * 3 + f"word{i} rare{i % 7}") for i in range(60)]


@pytest.fixture(scope="module")
def trained(spark):
    """A small model, the counts behind it, the encoded documents and how often each word occurs in training."""
    shape = lm.Shape(per_root=0.3, endings=6, dims=4, batch=64)
    docs = spark.createDataFrame(CAT, "doc_id long, text string")
    training = [r for r in CAT if not out(r[0])]
    chunks = wordtable.split_words(docs, lower_words, lambda doc: not lm.held_out(doc))
    answers, counts = lm.count_words(chunks, len(training), shape)
    encoded = lm.encode(chunks, answers, counts)
    c = Counter(t.encode() for _, text in training for t in tokens(text) if t)
    return lm.train(encoded, counts), counts, encoded, c


def plain_scores(model, u, v):
    """Natural log of the probability of every output, class by class."""
    h = model.order[0] * model.context[u] + model.order[1] * model.context[v]
    group = model.group[:, :-1] @ h + model.group[:, -1]
    held = {int(k) for k, closed in zip(model.classes.of, model.blocked, strict=True) if not closed}
    group = group - math.log(sum(math.exp(x) for k, x in enumerate(group) if k in held))
    result = np.full(len(model.target), -math.inf)
    for k in range(len(group)):
        mine = [w for w in range(len(result)) if model.classes.of[w] == k and not model.blocked[w]]
        scores = [float(model.target[w, :-1] @ h + model.target[w, -1]) for w in mine]
        total = math.log(sum(map(math.exp, scores))) if mine else 0
        for w, x in zip(mine, scores, strict=True):
            result[w] = group[k] + x - total
    return result


def test_probabilities_sum_to_one(trained):
    model, counts, _, c = trained
    assert len(model.classes) > 1 and 8 < counts.outputs < len(c)
    words = [*c, b"never seen before"]
    output, share = counts.outputs_of(words, np.array([c[w] for w in words]))
    m = counts.outputs
    for u, v in ((m, m), (0, 3), (9, 1)):
        every = np.arange(m)
        log_p = model.log_probabilities(every, np.full(m, u), np.full(m, v))
        expected = plain_scores(model, u, v)
        there = np.isfinite(expected)
        assert np.allclose(log_p[there], expected[there], atol=1e-4)
        total = sum(math.exp(log_p[o]) * 10**s for o, s in zip(output, share, strict=True)) + math.exp(log_p[lm.END])
        assert total == pytest.approx(1, abs=1e-4)


def test_scores_of_texts(trained):
    """The score of every text against one worked out token by token."""
    model, counts, encoded, c = trained
    rows = {r.doc_id: r for r in lm.score(encoded, counts, model).collect()}
    for doc, text in CAT[:12]:
        words = [t.encode() for t in tokens(text)[:-1]]
        output, share = counts.outputs_of(words, np.array([c[w] for w in words]))
        u = v = counts.outputs
        total = float(share.sum())
        for o in [*output.tolist(), lm.END]:
            total += plain_scores(model, u, v)[o] / math.log(10)
            u, v = o, u
        assert rows[doc].score == pytest.approx(total, abs=1e-3)


def test_words_with_an_output_grow_with_the_corpus():
    sizes = [lm.Shape().singles(n) for n in (0, 10**4, 10**6, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] >= 1 and sizes[-1] == 10**6 + 1


def test_classes_are_a_partition():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(size=(300, 5)) * 0.01, rng.normal(size=(100, 5))]).astype(np.float32)
    counts = rng.integers(0, 1000, 400)
    for classes in (lm.by_vectors(vectors, counts), lm.by_frequency(counts), lm.by_vectors(vectors[:1], counts[:1])):
        members = [classes.order[a:b] for a, b in zip(classes.start, classes.start[1:], strict=False)]
        assert sorted(np.concatenate(members)) == list(range(len(classes.of))) and all(len(x) for x in members)
        assert all((classes.of[x] == k).all() for k, x in enumerate(members))
    assert max(len(x) for x in [np.flatnonzero(lm.by_vectors(vectors, counts).of == k) for k in range(20)]) <= 40


def test_other_classes_change_no_vector(trained):
    model, counts, _, _ = trained
    copy = lm.Model.start(counts)
    vectors = copy.whole()
    copy.regroup(counts, lm.by_vectors(vectors, counts.output_counts), vectors)
    assert np.allclose(copy.whole(), vectors, atol=1e-6) and len(copy.group) == len(copy.classes)


def test_training_brings_the_words_of_a_context_up(trained):
    model, counts, _, _ = trained
    cat, sat = counts.vocabulary.get(b"cat"), counts.vocabulary.get(b"sat")
    the = counts.vocabulary.get(b"the")
    if None not in (cat, sat, the):
        before = lm.Model.start(counts)
        at = np.array([sat]), np.array([cat]), np.array([the])
        assert model.log_probabilities(*at)[0] > before.log_probabilities(*at)[0] + 0.5


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = queries.QUERIES["op4_lm_scores"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > 0.87 * sum(r.base_score for r in held)
