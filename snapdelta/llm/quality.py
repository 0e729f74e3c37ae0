"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches per language and source.

A sketch is a histogram over buckets of fixed relative width, kept as rows. Sketches of sources add up to that of
their language and these to that of all, so one pass over the documents serves all levels. A fence is the middle of the first gap in the
outer quarter of a group's sketch that is wide for what lies before it: there the body of the group ends and something else begins. A group
without such a gap has no fence of its own. Fences are drawn towards those of the level above, the more the smaller the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import document, short_batches, written

_SYMBOLS = b"#*$%&|<>"
_WHITE = " \t\n\v\f\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths, its parts, and the least width of a gap, which is no threshold itself."""

    name: str
    part: str
    whole: str
    gap: int
    both_sides: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 500, both_sides=True),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 150),
    Rule("stutters", "n_stutters", "n_words", 100),
)
#: The level above counts like so many documents. Where it has no fence, a group with fewer documents than that half has none either.
LEAN, LEAST_ROWS = 200, 100


def count_words(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``. A null text has none of anything."""
    if not text:
        return (0,) * len(_COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split()]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(h, 8), len(lines), int((h[1:] == h[:-1]).sum())


def _repeated(h: np.ndarray, size: int) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(h) - size + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(h) + 1, np.int64)
    edges[np.flatnonzero(twice)] += 1
    edges[np.flatnonzero(twice) + size] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    short_batches(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"),
        docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_words(text.as_py()) for text in batch.column(3)]
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "lang", "source", *_COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(count, schema)


def measure(rule: Rule) -> Column:
    return F.expr(f"{rule.part} * 1000 DIV nullif({rule.whole}, 0)")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: exact below 1024, then within a thousandth."""
    shift = F.greatest(F.length(F.bin(value)) - 10, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """Rows ``lang, source, rule, bucket, n`` over documents that the base rules accept."""
    values = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(measure(r)).alias("bucket")) for r in RULES)))
    rows = counts.select("lang", "source", values.alias("v")).where("v.bucket IS NOT NULL")
    return rows.groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``low``, ``high`` and the number of documents per group and rule, from sketches merged to ``keys``; null where there is no gap.

    A gap counts if it is half as wide again as the outer part of the body: from the median to the ninth tenth, or to the gap if that
    is nearer. A window holds the buckets of one group, some thousand at most.
    """
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    by_bucket = group.orderBy("bucket")
    up_to = by_bucket.rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"below": F.sum("n").over(up_to), "rows": F.sum("n").over(group), "next": F.lead("bucket").over(by_bucket)})

    def quantile(tenths: int) -> Column:
        return F.min(F.when(F.col("below") * 10 >= F.col("rows") * tenths, F.col("bucket"))).over(group).alias(f"q{tenths}")

    ranked = ranked.select("*", *(quantile(q) for q in (1, 5, 9)), _of_rule("gap").alias("least"), _of_rule("both_sides").alias("both_sides"))
    width, middle = F.expr("next - bucket"), F.expr("(bucket + next) DIV 2")
    wide = width >= F.col("least")
    above = wide & F.expr("below * 4 >= rows * 3 AND 2 * (next - bucket) >= 3 * (least(q9, bucket) - q5)")
    under = wide & F.expr("both_sides = 1 AND (rows - below) * 4 >= rows * 3 AND 2 * (next - bucket) >= 3 * (q5 - greatest(q1, next))")
    return ranked.groupBy(*keys, "rule").agg(
        F.max("rows").alias("rows"), F.max_by(middle, F.when(under, F.col("bucket"))).alias("low"),
        F.min_by(middle, F.when(above, F.col("bucket"))).alias("high"),
    )


def _of_rule(field: str) -> Column:
    return F.create_map(*(F.lit(x) for r in RULES for x in (r.name, int(getattr(r, field)))))[F.col("rule")]


def thresholds(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per language and source: ``limits``, a map from rule to its fences, drawn from source to language to all documents."""
    total = fences(sketch, []).select("rule", F.struct("low", "high").alias("above"))
    by_lang = fences(sketch, ["lang"]).join(total, "rule")
    by_lang = by_lang.select("lang", "rule", _drawn(least_rows).alias("above"))
    by_source = fences(sketch, ["lang", "source"]).alias("s").join(
        by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.rule") == F.col("l.rule"))
    )
    rows = by_source.select("s.lang", "s.source", "s.rule", _drawn(least_rows).alias("limit"))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias("limits"))


def _drawn(least_rows: int) -> Column:
    """A group's fences, drawn towards those above."""

    def drawn(side: str) -> Column:
        own, above = F.col(side), F.col("above")[side]
        between = F.expr(f"(rows * {side} + {LEAN} * above.{side}) DIV (rows + {LEAN})")
        alone = F.when(F.col("rows") >= least_rows, own)
        return F.when(own.isNull(), above).when(above.isNull(), alone).otherwise(between).alias(side)

    return F.struct(drawn("low"), drawn("high"))


def judged(
    docs: DataFrame, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, broken (the rules it breaks) and kept.

    ``base_failed``: fewer than 20 words, or more than 30 % of them in repeated windows of 8 words. The sketches
    are made of the other documents. A null language or source is a group like any other, a null text has
    no words and fails. Repeated rows count each for itself; an empty table gives no rows.
    """
    counts, limits = _counts_and_limits(docs, least_rows, id_col, text_col, lang_col, source_col)
    rows = _limited(counts, limits).select("doc_id", *_COUNTS, "base_failed", _broken().alias("broken"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def accepted(
    docs: DataFrame, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns. Texts are counted where they are read and not shuffled."""
    _, limits = _counts_and_limits(docs, least_rows, id_col, text_col, lang_col, source_col)

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def counted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_words(t) for t in text], columns=list(_COUNTS))

    rows = docs.select(
        document(docs), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"),
        counted(docs[text_col]).alias("counts"),
    ).select("document", "lang", "source", "counts.*").withColumn("base_failed", _failed())
    kept = _limited(rows, limits).where(~F.col("base_failed") & (F.size(_broken()) == 0))
    return kept.select("document.*")


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _counts_and_limits(docs: DataFrame, least_rows: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    counts = written(measured(docs, *columns), "counts").withColumn("base_failed", _failed())
    return counts, written(thresholds(sketches(counts.where(~F.col("base_failed"))), least_rows), "limits")


def _limited(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "limits")
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(limits, same, "left")


def _broken() -> Column:
    def breaks(rule: Rule) -> Column:
        value, limit = measure(rule), F.col("limits")[rule.name]
        return F.when((value > limit.high) | (value < limit.low), F.lit(rule.name))

    return F.array_compact(F.array(*(breaks(r) for r in RULES)))
