"""The registered queries of the operators and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import bpe, filter_audit, lm, merkle, minhash, packing, quality, range_join, shards, site_tree, suffix, token_files, toxicity
from snapdelta.llm.common import table
from snapdelta.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, word_tokenizer(), end_id=2)
    return token_files.token_digests(spark, folder)


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


@query()
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), word_tokenizer())


@query()
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT rid, array_to_string(words[i:i + 4], ' ') AS shingle
        FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM texts WHERE len(words) > 0)
    ),
    sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
    common AS (
        SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rid <> b.rid
        GROUP BY a.rid, b.rid
    ),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
        WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
    ),
    reach(rid, other) AS (
        SELECT rid, rid FROM texts UNION SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a
    ),
    least AS (SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN texts o ON o.rid = reach.other GROUP BY reach.rid)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM texts JOIN least USING (rid) LEFT JOIN sizes USING (rid)
    """
)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_strings(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _drawn(side: str, above: str) -> str:
    return f"""CASE WHEN f.{side} IS NULL THEN {above}.{side} WHEN {above}.{side} IS NULL THEN CASE WHEN f.total >= {quality.LEAST_ROWS} THEN f.{side} END
        ELSE (f.total * f.{side} + {quality.LEAN} * {above}.{side}) // (f.total + {quality.LEAN}) END AS {side}"""


QUALITY_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
places AS (
    SELECT rid, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS eight,
        unnest(range(1, len(words) - 6)) AS pos
    FROM texts
),
windows AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, eight) AS times FROM places),
covered AS (
    SELECT rid, count(DISTINCT pos + k) AS n
    FROM windows, (SELECT unnest(range(0, 8)) AS k) WHERE times > 1 GROUP BY rid
),
stutters AS (
    SELECT rid, list_sum(list_transform(range(2, len(words) + 1), lambda i: (words[i] = words[i - 1])::INT)) AS n FROM texts
),
counts AS (
    SELECT rid, doc_id, lang, source, len(words) AS n_words,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(stutters.n, 0)::BIGINT AS n_stutters
    FROM texts LEFT JOIN covered USING (rid) LEFT JOIN stutters USING (rid)
),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
rules(rule, least, both_sides) AS (
    VALUES {", ".join(f"('{r.name}', {r.gap}, {r.both_sides})" for r in quality.RULES)}
),
measures AS (
    {" UNION ALL ".join(f"SELECT rid, '{r.name}' AS rule, {r.part} * 1000 // nullif({r.whole}, 0) AS value FROM based" for r in quality.RULES)}
),
sketch AS (
    SELECT lang, source, rule, (value >> greatest(length(bin(value)) - 10, 0)) << greatest(length(bin(value)) - 10, 0) AS bucket,
        count(*) AS n
    FROM measures JOIN based USING (rid) WHERE NOT base_failed AND value IS NOT NULL GROUP BY ALL
),
levels AS (
    SELECT 2 AS level, lang, source, rule, bucket, n FROM sketch
    UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM sketch GROUP BY ALL
    UNION ALL SELECT 0, NULL, NULL, rule, bucket, sum(n) FROM sketch GROUP BY ALL
),
ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS below,
        sum(n) OVER (PARTITION BY level, lang, source, rule) AS total,
        lead(bucket) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS next
    FROM levels
),
quantiles AS (
    SELECT level, lang, source, rule, min(bucket) FILTER (WHERE below * 10 >= total) AS q1,
        min(bucket) FILTER (WHERE below * 10 >= total * 5) AS q5, min(bucket) FILTER (WHERE below * 10 >= total * 9) AS q9
    FROM ranked GROUP BY ALL
),
gaps AS (
    SELECT r.*, below * 4 >= total * 3 AND 2 * (next - bucket) >= 3 * (least(q9, bucket) - q5) AS above,
        both_sides AND (total - below) * 4 >= total * 3 AND 2 * (next - bucket) >= 3 * (q5 - greatest(q1, next)) AS under,
        next - bucket >= rules.least AS wide
    FROM ranked r JOIN rules USING (rule) JOIN quantiles q
        ON q.level = r.level AND q.lang IS NOT DISTINCT FROM r.lang AND q.source IS NOT DISTINCT FROM r.source AND q.rule = r.rule
),
fences AS (
    SELECT level, lang, source, rule, max(total) AS total, arg_max((bucket + next) // 2, bucket) FILTER (WHERE wide AND under) AS low,
        arg_min((bucket + next) // 2, bucket) FILTER (WHERE wide AND above) AS high
    FROM gaps GROUP BY ALL
),
by_lang AS (
    SELECT f.lang, f.rule, {_drawn("low", "a")}, {_drawn("high", "a")} FROM fences f JOIN fences a ON f.rule = a.rule AND f.level = 1 AND a.level = 0
),
by_source AS (
    SELECT f.lang, f.source, f.rule, {_drawn("low", "a")}, {_drawn("high", "a")}
    FROM fences f JOIN by_lang a ON f.rule = a.rule AND f.lang IS NOT DISTINCT FROM a.lang AND f.level = 2
),
broken AS (
    SELECT rid, count(*) AS n FROM measures JOIN based USING (rid)
    JOIN by_source s ON s.rule = measures.rule AND s.lang IS NOT DISTINCT FROM based.lang AND s.source IS NOT DISTINCT FROM based.source
    WHERE value > high OR value < low GROUP BY rid
)
"""


@query(
    QUALITY_SQL
    + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND broken.rid IS NULL AS kept
    FROM based LEFT JOIN broken USING (rid)
    """
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("n_lines", "n_stutters", "broken")


@query()
def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


@query(
    """
    WITH RECURSIVE vectors AS (
        SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    ),
    sized AS (
        SELECT rid, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM vectors
        WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    links AS (
        SELECT a.rid AS a, b.rid AS b FROM sized a JOIN sized b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
        WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
    ),
    reach(rid, other) AS (
        SELECT rid, rid FROM vectors UNION SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a
    ),
    least AS (SELECT reach.rid, min(o.vec_id) AS component_id FROM reach JOIN vectors o ON o.rid = reach.other GROUP BY reach.rid),
    counted AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM vectors JOIN least USING (rid) LEFT JOIN counted USING (rid)
    """
)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.linked_embeddings(table(spark, sf_dir, "embeddings"))


@query()
def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extracted(table(spark, sf_dir, "pages"))


@query(
    rf"""
    WITH measures AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words,
            doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_copy
        FROM documents
    ),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    failing AS (
        SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
            + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
            + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(is_copy, false)::INT AS mask,
            count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM measures LEFT JOIN marks USING (doc_id) GROUP BY ALL
    ),
    letters AS (SELECT unnest(range(5)) AS bit),
    orders AS (
        SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
    ),
    steps AS (
        SELECT array_to_string(list_transform(bits, lambda x: chr(65 + x::INT)), '') AS filter_order, step::INT AS step,
            1 << bits[step]::INT AS bit, coalesce(list_sum(list_transform(bits[1:step - 1], lambda x: 1 << x::INT)), 0)::INT AS earlier
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ),
    counted AS (
        SELECT part, filter_order, step, bit,
            sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM failing, steps GROUP BY ALL
    )
    SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
    """
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    r"""
    WITH RECURSIVE fields AS (
        SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
            text, replace(text, chr(10), '') AS cut, list_reduce(
                [4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                    lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) & 1 = 1 AS chosen
        FROM documents
    ),
    hashed AS (
        SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN coalesce(chosen, false) THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS altered
        FROM fields
    ),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
        FROM hashed
    ),
    nodes(lvl, tree, place, n, hash) AS (
        SELECT 0, tree, place, n, leaf FROM leaves
        UNION ALL
        SELECT lvl + 1, tree, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY place))
        FROM nodes WHERE n > 1 GROUP BY lvl, tree, place // 3
    ),
    subroots AS (
        SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
    ),
    tops(lvl, place, n, hash) AS (
        SELECT 0, place, n, hash FROM subroots
        UNION ALL
        SELECT lvl + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY place))
        FROM tops WHERE n > 1 GROUP BY lvl, place // 3
    ),
    beside AS (
        SELECT a.lvl, a.tree, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
            coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
        FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL
    ),
    beside_tops AS (
        SELECT a.lvl, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
            coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
        FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL
    ),
    folds(rid, tree, lvl, place, n, hash, proof) AS (
        SELECT rid, tree, 0, place, n, coalesce(altered, leaf), '' FROM leaves
        UNION ALL
        SELECT rid, f.tree, f.lvl + 1, f.place // 3, (n + 2) // 3, sha256(before || hash || after), proof || before || after
        FROM folds f JOIN beside b ON b.lvl = f.lvl AND b.tree = f.tree AND b.place = f.place WHERE n > 1
    ),
    top_folds(rid, lvl, place, n, hash, proof) AS (
        SELECT rid, 0, s.place, s.n, f.hash, proof FROM folds f JOIN subroots s USING (tree) WHERE f.n = 1
        UNION ALL
        SELECT rid, f.lvl + 1, f.place // 3, (n + 2) // 3, sha256(before || hash || after), proof || before || after
        FROM top_folds f JOIN beside_tops b ON b.lvl = f.lvl AND b.place = f.place WHERE n > 1
    )
    SELECT doc_id, leaf, subroots.hash AS subroot, root.hash AS root, sha256(proof) AS proof_sha256, f.hash AS folded_root,
        f.hash = root.hash AS verified
    FROM leaves JOIN subroots USING (tree) JOIN top_folds f ON f.rid = leaves.rid AND f.n = 1, (SELECT hash FROM tops WHERE n = 1) root
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.versions(table(spark, sf_dir, "documents"))


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
