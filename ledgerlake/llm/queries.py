"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conv_toxicity import toxicity
from .disclosure_pii import found_and_sanitised
from .gumbel_segments import segmentations
from .heavy_dedup import exact_duplicates
from .line_cleaning import BOILERPLATE, NOTICE_WORDS, quality_report
from .minimax_shards import minimax_shards
from .periodic_runs import planted_periods, run_digests
from .prefix_tree_join import jaccard_components
from .recurrent_html import main_texts
from .ss_packing import packed
from .target_alignment import damaged, repair_report
from .wavelet_ids import wavelet_ids
from .wu_manber import contamination_digests


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segmentations of every text without replacement, with inclusion scores."""
    return segmentations(table(spark, sf_dir, "documents"), 3)


def op2_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes; equal texts share a shard."""
    out = minimax_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_ids(table(spark, sf_dir, "documents"))


def op6_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("cleaned")


def op7_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms; the sanitised text by its checksum."""
    return found_and_sanitised(table(spark, sf_dir, "documents")).withColumn("sanitised_crc32", F.crc32(F.col("sanitised").cast("binary"))).drop("sanitised")


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_recurrent_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op11_descending_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of words; a tenth of the documents get a periodic tail first."""
    return run_digests(planted_periods(table(spark, sf_dir, "documents")))


def op12_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of damaged conversations."""
    return repair_report(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside a benchmark item's ten consecutive words."""
    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_gumbel_segmentations, op2_prefix_tree_jaccard, op3_minimax_shards, op4_heavy_hitter_dedup, op5_wavelet_ids, op6_line_first_cleaning,
        op7_conv_toxicity, op8_disclosure_sanitisation, op9_sum_of_squares_packing, op10_recurrent_main_text,
        op11_descending_lcp_runs, op12_target_alignment, op13_wu_manber)}

#: Words of a text: runs without blank and U+0009 to U+000D.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_PHRASES = "|".join(BOILERPLATE)
#: Words of lower-cased ASCII letters, digits and characters beyond ASCII.
_PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _bad(pattern: str, share: int) -> str:
    """A line has a pattern three times, and once in ``share`` words."""
    n = f"len(regexp_extract_all(line, '{pattern}'))"
    return f"({n} >= 3 AND {n} * {share} >= len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')))"


ORACLES: dict[str, str] = {
    # Repeated keys count as documents of their own: r numbers rows.
    "op2_prefix_tree_jaccard": rf"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS r, doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
          FROM documents),
        s AS (
          SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        links AS (
          SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r)
          JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        least AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.r = y GROUP BY x)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least ON least.x = d.r""",
    "op4_heavy_hitter_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_line_first_cleaning": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        windows AS (
          SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
          FROM d, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS u(i)),
        repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2]) AS v(k) WHERE n > 1 GROUP BY r),
        lines AS (SELECT r, line, len(line) AS n FROM d, unnest(string_split(text, chr(10))) AS u(line)),
        worded AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        failing AS (
          SELECT r, sum(n) AS chars, count(*) AS n FROM lines
          WHERE (regexp_matches(lower(line), '{_PHRASES}') AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= {NOTICE_WORDS}) OR {_bad("[|•·»«›‹→←]", 5)} OR {_bad("[#*$%&<>~^=_\\\\]{2,}", 3)} OR {_bad("[!?]{2,}", 3)} GROUP BY r),
        f AS (
          SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                 coalesce(repeats.n, 0) AS n_repeat_words, length(text) AS chars,
                 -- Removed lines take their line breaks along, but for one if nothing stays.
                 least(length(text), coalesce(failing.chars + failing.n, 0)) AS lost
          FROM d LEFT JOIN repeats USING (r) LEFT JOIN worded USING (r) LEFT JOIN failing USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * chars AS kept
        FROM f""",
    "op13_wu_manber": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN_WORDS} AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS words
          FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
          SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(k)),
        found AS (SELECT r, k, n, item_id FROM places JOIN windows USING (n, words)),
        hit AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM found) s, unnest(range(0, n)) AS v(j) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) s GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
