"""Filter audit: path counts against factorials, the whole table against every order tried by hand."""

from __future__ import annotations

import math
import re
from itertools import permutations

import pytest

from snapdelta.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def plain(docs, labels, names="ABCDE"):
    """Every order applied to every document in turn."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    fails = []
    for i, text, _ in texts:
        words = WORD.findall(text)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and t == text for j, t, _ in texts),
        }
        fails.append({n for n in names if failed[n]})
    marks = [[any(i is not None and k == i and flags[f] == 1 for k, *flags in labels) for f in (0, 1)] for i, *_ in texts]
    result = []
    for part in {p for *_, p in texts}:
        members = [k for k, (*_, p) in enumerate(texts) if p == part]
        removed_in_all = dict.fromkeys(names, 0)
        found = []
        for order in permutations(names):
            for step, letter in enumerate(order):
                earlier = set(order[:step])
                lost = [k for k in members if letter in fails[k] and not fails[k] & earlier]
                removed_in_all[letter] += len(lost)
                found.append([
                    part, "".join(order), step + 1, sum(not fails[k] & (earlier | {letter}) for k in members), len(lost),
                    sum(letter in fails[k] and bool(fails[k] & earlier) for k in members), sum(fails[k] == {letter} for k in members),
                    sum(marks[k][0] for k in lost), sum(marks[k][1] for k in lost), letter,
                ])
        result += [tuple(row[:-1]) + (removed_in_all[row[-1]],) for row in found]
    return sorted(result)


def test_paths_through_edges_are_factorials():
    edges = filter_audit.lattice(5)
    assert len(edges) == 80
    for before, bit, after, through in edges:
        size = before.bit_count()
        assert after == before | bit and not before & bit
        assert through == math.factorial(size) * math.factorial(4 - size)


@pytest.fixture
def rows(awkward):
    long = " ".join(f"w{k}" for k in range(120))
    varied = [(20 + k, text, lang) for k, (text, lang) in enumerate([
        (long, "en"), (long, "en"), (long, None), (long + " #", "en"), (long.upper(), "de"), ("a b " * 80, "de"), ("A B " * 80 + "$", "de"),
        (long + "\x1c\xa0é", "fr"), ("", "fr"), (None, "fr"), (" \n\t", "fr"), ("x " * 100, "fr"),
    ])]
    return varied + [(i, t, "mixed") for i, t in awkward] + [(20, long, "en")] * 3 + [(None, long, "en")] * 2


LABELS = [(20, 1, 0), (20, 0, None), (21, 1, 1), (22, None, 1), (24, 0, 1), (6, 1, 1), (None, 1, 1), (999, 1, 1), (26, 1, 0)]


def test_against_every_order_by_hand(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS mask", "3 AS part", "4 AS `a.b`", "5 AS good", "6 AS digest")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS n", "2 AS text", "3 AS good")
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == plain(rows, LABELS)


def test_no_labels_and_no_documents(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame(rows[:5], SCHEMA)
    assert sorted(map(tuple, filter_audit.audit(some, labels).collect())) == plain(rows[:5], [])
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_other_filters(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    some = {name: filter_audit.FILTERS[name] for name in "DA"}
    found = filter_audit.audit(spark.createDataFrame(rows, SCHEMA), labels, some)
    assert sorted(map(tuple, found.collect())) == plain(rows, LABELS, "DA")
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame(rows, SCHEMA), labels, dict.fromkeys("ABCDEFGHI", "true"))
