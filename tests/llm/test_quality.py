"""Quality rules: counts against plain Python, the query against its SQL, and which documents go."""

from __future__ import annotations

import re

import duckdb
import pyarrow.parquet as pq
import pytest

from snapdelta.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_counts(awkward, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in [t for _, t in awkward] + stored + ["a b c d e f g h " * 3, "x\n\n x\nx\n \t\nx"]:
        assert quality.count_words(text) == plain(text)


def test_query_equals_its_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = connection.execute(queries.ORACLES["op2_quality_rules"])
    names = sorted(c[0] for c in expected.description)
    rows = expected.fetchdf()[names].values.tolist()
    found = queries.QUERIES["op2_quality_rules"](spark, sf_dir)
    assert sorted(map(str, rows)) == sorted(str([r[n] for n in names]) for r in found.collect())


def sentence(i):
    return " ".join(f"word{(i * 37 + k * 11) % 997}" for k in range(60 + i % 40))


def test_thresholds_follow_language_and_source(spark):
    """A source of tables full of bars keeps them; the same text elsewhere goes."""
    bars = [(i, sentence(i).replace(" ", " | "), "en", "tables") for i in range(150)]
    prose = [(1000 + i, sentence(i), "en", "prose") for i in range(400)]
    odd = [(5000, sentence(3).replace(" ", " | "), "en", "prose"), (5001, "### $$$ %%% " * 30, "en", "small")]
    df = spark.createDataFrame(bars + prose + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert all(kept[1000 + i] for i in range(400)) and all(kept[i] for i in range(150))
    assert not kept[5000] and not kept[5001]


def sketch_of(spark, values, rule="symbols", lang="en", source="s"):
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return spark.createDataFrame([(lang, source, rule, v, n) for v, n in counts.items()], "lang string, source string, rule string, bucket long, n long")


@pytest.mark.parametrize(
    ("rule", "values", "low", "high"),
    [
        ("symbols", [0] * 90 + [400] * 6 + [2900] * 4, None, 200),  # the first gap, not the widest
        ("symbols", [0] * 60 + [400] * 40, None, None),  # a body of its own, no tail
        ("symbols", [0] * 90 + [90] * 10, None, None),  # too near
        ("symbols", list(range(0, 1000, 10)), None, None),
        ("word_length", [*range(4500, 5500, 10), 7300, 7400], None, 6395),
        ("word_length", [2000, *range(4500, 5500, 10), 9000], 3250, 7245),
        ("word_length", [*range(3000, 7000, 20), 7900], None, None),  # a gap no wider than the body's outer part
        ("symbols", [5], None, None),
    ],
)
def test_fences_are_gaps_of_the_sketch(spark, rule, values, low, high):
    row = quality.fences(sketch_of(spark, values, rule), ["lang", "source"]).first()
    assert (row.low, row.high, row["rows"]) == (low, high, len(values))


def test_fences_are_drawn_by_size(spark):
    def limits(n):
        own = sketch_of(spark, [0] * n + [1000] * (n // 10), source="own")
        others = sketch_of(spark, [0] * 20_000 + [200] * 2000, source="others")
        rows = quality.thresholds(own.unionByName(others)).collect()
        return next(r.limits["symbols"].high for r in rows if r.source == "own")

    found = [limits(n) for n in (10, 100, 1000, 10_000)]
    assert found == sorted(found) and found[0] < 150 and found[-1] > 450


def test_the_sketch_decides_in_most_groups(spark):
    """Every fence is a gap of some sketch; of the rules that junk breaks, nearly all groups have a gap of their own at sf0.1, others that of
    their language or of all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counts, limits = quality._counts_and_limits(docs, quality.LEAST_ROWS, "doc_id", "text", "lang", "source")
    sketch = quality.sketches(counts.where("NOT base_failed"))
    own = {}
    for r in quality.fences(sketch, ["lang", "source"]).collect():
        own.setdefault(r.rule, []).append(r.high is not None)
    assert sum(own["symbols"]) > 0.9 * len(own["symbols"]) and sum(own["word_length"]) > 0.8 * len(own["word_length"])
    drawn = {rule: [r.limits[rule].high for r in limits.collect()] for rule in own}
    assert all(None not in drawn[rule] and len(set(drawn[rule])) > least for rule, least in (("symbols", 20), ("word_length", 20), ("stutters", 8)))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (1, None, None, None), (None, sentence(1), None, "s"), (2, "", "en", None)]])
def test_awkward_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "7 AS `a.b`", "1 AS n_words", "2 AS rule", "3 AS limits", "4 AS bucket")
    result = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in quality.judged(df).collect())
    expected = sorted((str(r[0]), len((r[1] or "").split()), len((r[1] or "").split()) < 20, len((r[1] or "").split()) >= 20) for r in rows)
    assert result == expected


def test_labelled_documents(spark):
    """On labelled documents nearly all good ones stay and nearly all bad ones go."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = queries.QUERIES["op2_quality_rules"](spark, folder).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.02 * len(bad)
