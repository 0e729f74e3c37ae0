"""Documents into shards of equal counts, with equal texts together: balanced label propagation.

Only DataFrame functions. The graph links documents with equal texts. In each round a document asks to move to the
shard where most of its neighbours are, by joins with the counts of its group, and quotas let in as many as
the shard can hold. What is left over, and the documents without links, fill the rest, so that counts differ
by one at most. Quotas are found from counts by hash bin: nothing larger than shards times bins is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import texts, written

#: Bins in which a shard's requests are counted, and documents in a block whose rows are numbered by one task.
BINS, BLOCK = 512, 4096


def _bin(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BINS))


def _keyed(values: dict[int, int] | list[int], key: Column) -> Column:
    """A small fixed list of numbers, one per shard, as a look-up."""
    pairs = values.items() if isinstance(values, dict) else enumerate(values)
    return F.create_map(*(F.lit(int(x)) for pair in pairs for x in pair))[key]


def numbered(df: DataFrame, group: list[str], name: str, rows: int) -> DataFrame:
    """Adds ``name``: a gapless number from 0 within each group, however large the group.

    Rows fall into blocks by hash; a window numbers the rows of one block, another adds up the blocks of a group.
    """
    blocks = max(1, rows // BLOCK)
    dealt = df.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    sizes = dealt.groupBy(*group, "block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("block_rows").over(before), F.lit(0))).drop("block_rows")
    within = Window.partitionBy(*group, "block").orderBy("uid")
    joined = dealt.join(bases, [*group, "block"])
    return joined.withColumn(name, F.col("base") + F.row_number().over(within) - 1).drop("block", "base")


def _wishes(linked: DataFrame, capacity: list[int]) -> DataFrame:
    """Adds ``target``: the shard that suits the document's group best, or one of as many as the group needs.

    A shard suits by the part of the group, or of a full shard, that is there, plus half the part of its room that linked documents
    leave free. The documents of a group larger than a shard choose among its best shards by hash.
    """
    load = {int(s): n for s, n in linked.groupBy("shard").count().collect()}
    free = [500 * max(0, c - load.get(s, 0)) // max(1, c) for s, c in enumerate(capacity)]
    largest = max(1, min(capacity))
    counts = linked.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("g1", "g2").agg(F.collect_list(F.struct("n", "shard")).alias("there"), F.sum("n").alias("members"))
    scored = F.transform(
        "there",
        lambda x: F.struct(
            (F.floor(1000 * x.n / F.least(F.col("members"), F.lit(largest))) + _keyed(free, x.shard)).alias("score"),
            F.xxhash64("g1", x.shard).alias("tie"),
            x.shard.alias("shard"),
        ),
    )
    wanted = F.ceil(F.col("members") / F.lit(largest)).cast("int")
    best = F.slice(F.reverse(F.array_sort(scored)), F.lit(1), F.greatest(wanted, F.lit(1)))
    groups = groups.withColumn("aims", F.transform(best, lambda x: x.shard))
    joined = linked.join(groups.select("g1", "g2", "aims"), ["g1", "g2"])
    chosen = F.element_at("aims", (F.pmod(F.xxhash64("uid"), F.size("aims")) + 1).cast("int"))
    return joined.withColumn("target", F.when(F.array_contains("aims", F.col("shard")), F.col("shard")).otherwise(chosen)).drop("aims")


def _round(linked: DataFrame, capacity: list[int]) -> tuple[DataFrame, int]:
    """One round of moves under quotas; the number of documents that moved."""
    shards = len(capacity)
    wishes = written(_wishes(linked, capacity), "wishes")
    movers = wishes.where("target <> shard")
    stay = {int(s): n for s, n in wishes.where("target = shard").groupBy("shard").count().collect()}
    room = [max(0, capacity[s] - stay.get(s, 0)) for s in range(shards)]
    # Whole groups go first, by bin of their key; of the bin that no longer fits, single documents by bin of their own.
    coarse = movers.withColumn("bin", _bin("g1", "g2")).groupBy("target", "bin").agg(F.count(F.lit(1)).alias("n"))
    cuts, left = _cuts(coarse.collect(), room)
    cut = _keyed(cuts, F.col("target"))
    edge = movers.where(_bin("g1", "g2") == cut).withColumn("bin", _bin("uid", F.lit(1)))
    fine, _ = _cuts(edge.groupBy("target", "bin").agg(F.count(F.lit(1)).alias("n")).collect(), left)
    own = _bin("uid", F.lit(1)) < _keyed(fine, F.col("target"))
    goes = (F.col("target") != F.col("shard")) & ((_bin("g1", "g2") < cut) | ((_bin("g1", "g2") == cut) & own))
    moved = wishes.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard")))
    number = wishes.where(goes).count()
    return written(moved.drop("target"), "moved"), number


def _cuts(counts: list, room: list[int]) -> tuple[list[int], list[int]]:
    """Per shard, the first bin that does not fit into its room any more, and the room left before it."""
    by_shard: dict[int, dict[int, int]] = {}
    for target, b, n in counts:
        by_shard.setdefault(int(target), {})[int(b)] = n
    cuts, left = [], []
    for s, free in enumerate(room):
        cut = BINS
        for b, n in sorted(by_shard.get(s, {}).items()):
            if n > free:
                cut = b
                break
            free -= n
        cuts.append(cut)
        left.append(free)
    return cuts, left


def assign(docs: DataFrame, shards: int = 40, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``rows``: shard counts differ by one at most, the first shards having one more. Equal texts are linked, null and
    empty ones alike. Rows with the same id count each for itself. An empty table gives no rows.
    ``grown_shard`` belongs to another law and is null. Rounds end early when nothing moves any more.
    """
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = texts(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("g1"), F.xxhash64(F.lit(1), content).alias("g2"),
    )
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    several = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    start = numbered(rows.select("uid", "g1", "g2"), [], "place", total)
    start = start.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).drop("place")
    linked = written(start.join(several.drop("members"), ["g1", "g2"]), "linked")
    for _ in range(rounds):
        linked, moved = _round(linked, capacity)
        if not moved:
            break
    return _filled(rows, linked, capacity, total).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _filled(rows: DataFrame, linked: DataFrame, capacity: list[int], total: int) -> DataFrame:
    """Linked documents keep their shard as far as it has room; all others fill the shards in order."""
    placed = written(numbered(linked.select("uid", "shard"), ["shard"], "slot", max(1, total // len(capacity))), "placed")
    fits = F.col("slot") < _keyed(capacity, F.col("shard"))
    settled = placed.where(fits)
    taken = {int(s): n for s, n in settled.groupBy("shard").count().collect()}
    fillers = rows.select("uid").join(settled.select("uid"), "uid", "left_anti")
    fillers = numbered(fillers, [], "place", total)
    first, starts = 0, []
    for s, c in enumerate(capacity):
        starts.append((s, first, taken.get(s, 0)))
        first += c - taken.get(s, 0)
    # Of the shards, the last that starts at or before a filler's place: a list of as many entries as shards.
    table = F.array(*(F.struct(F.lit(f).cast("long").alias("first"), F.lit(s).alias("shard"), F.lit(t).cast("long").alias("taken"))
                      for s, f, t in starts if capacity[s] > t))
    if first:
        at = F.element_at(F.filter(table, lambda x: x["first"] <= F.col("place")), -1)
        fillers = fillers.withColumn("at", at).select("uid", F.col("at.shard").alias("shard"), (F.col("at.taken") + F.col("place") - F.col("at.first")).alias("slot"))
        settled = settled.select("uid", "shard", "slot").unionByName(fillers)
    return rows.join(settled.select("uid", "shard", "slot"), "uid")
