"""The registered queries of this package: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, hmm, toxicity
from pulsegrid.llm.common import crc_bucket
from pulsegrid.llm.decontaminate import find_contamination, hit_words
from pulsegrid.llm.filter_audit import audit_documents
from pulsegrid.llm.hard_negatives import hard_negatives, quantised
from pulsegrid.llm.line_dedup import remove_repeated_chunks
from pulsegrid.llm.neighbours import nearest
from pulsegrid.llm.private_data import KINDS, find_private_data, span_text
from pulsegrid.llm.quality_rules import BASE, POLICIES, failed, kept, ledger
from pulsegrid.llm.sharding import shard_by_bytes, text_crc32, text_size
from pulsegrid.llm.simhash import simhash_groups
from pulsegrid.llm.style_tree import extract_main_text
from pulsegrid.session import apply_sql_defaults


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_sql_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are neighbours in the global order, so that at most the
    seven groups at the cuts are in two shards."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", text_size().alias("size"), text_crc32().alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"))
    return shard_by_bytes(docs, 8, "size", ["text_hash", "text_crc32", "doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    scored = hmm.score(docs, ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_chunks(docs)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_groups(docs, shingle=3, max_distance=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("private_data", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id", *[(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
                    for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("private_data")).alias("spans"))


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, VOCABULARY, ["doc_id"])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", hit_words(F.col("hit_spans")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"),
                         train=lambda c: crc_bucket(c, 5) != 0)
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantised("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return lines.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed(BASE).alias("base_failed"), kept(POLICIES[-1]).alias("kept"),
                        "failed_bits", "n_lines", "n_upper", "n_run_words")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_approximate_nearest_neighbours, op3_lm_scoring, op4_line_dedup, op5_simhash_near_dedup, op6_pii,
                                    op7_bpe_encoding_and_decoding, op8_html_extraction,
                                    op9_benchmark_decontamination, op10_toxicity,
                                    op11_filter_interaction_audit, op12_hard_negative_mining,
                                    op13_quality_rules)}


_ORACLE_9 = """with
    d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
          from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
          from benchmark),
    bi as (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0),
    bw as (select distinct item_id, list_slice(w, i, i + 9) as win from bi),
    sizes as (select distinct len(win) as n from bw),
    di as (select row, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
    dw as (select row, i, n, list_slice(w, i, i + n - 1) as win from di),
    m as (select dw.row, dw.i, dw.n, bw.item_id from dw join bw on dw.win = bw.win),
    hit as (select row, count(distinct p) as n_hit
            from (select row, unnest(range(i, i + n)) as p from m) group by row),
    item as (select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
             from (select distinct row, cast(item_id as varchar) as id from m) group by row)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hit.n_hit, 0) as n_hit,
      coalesce(item.n_items, 0) as n_items, sha256(coalesce(item.ids, '')) as items_sha256,
      coalesce(hit.n_hit, 0) > 0 as contaminated
    from d left join hit on d.row = hit.row left join item on d.row = item.row"""


_ORACLE_11 = """with
    d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
                 min(doc_id) over (partition by t) as first from d),
    l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
                 max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
    f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
            list_filter([case when len(w) < 100 then 'A' end,
              case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' end,
              case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' end,
              case when regexp_matches(t, '[#$%&*|]') then 'D' end,
              case when doc_id > first then 'E' end], lambda x: x is not null) as fails
          from w left join l using (doc_id)),
    c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
          where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r as (select c.*, filter_order, coalesce(list_min(list_transform(fails, lambda y: instr(filter_order, y))), 6) as gone
          from c, o),
    s as (select part, filter_order, step, substr(filter_order, step, 1) as x,
            sum(case when gone > step then n else 0 end) as kept,
            sum(case when gone = step then n else 0 end) as removed,
            sum(case when list_contains(fails, substr(filter_order, step, 1)) and gone < step then n else 0 end) as redundant,
            sum(case when fails = [substr(filter_order, step, 1)] then n else 0 end) as unique_fails,
            sum(case when gone = step then good else 0 end) as good_lost,
            sum(case when gone = step then toxic else 0 end) as toxic_lost
          from r, (select unnest([1, 2, 3, 4, 5]) as step) group by part, filter_order, step)
    select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
      cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
      cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
      cast(toxic_lost as bigint) as toxic_lost,
      cast(sum(removed) over (partition by part, x) as bigint) as shapley
    from s"""

_ORACLE_12 = """with
    e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
          from embeddings where vec_id is not null and label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
            cast(list_inner_product(a.v, b.v) as bigint) as score
          from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    good as (select anchor_id, vec_id as positive_id, score as positive_score from p where same
             qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select g.anchor_id, positive_id,
      cast(row_number() over (partition by g.anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
      vec_id as negative_id, positive_score, score as negative_score
    from good g join p on g.anchor_id = p.anchor_id and not same
      and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
    qualify row_number() over (partition by g.anchor_id, positive_id order by score desc, vec_id) <= 5"""

_ORACLE_13 = """with
    d as (select row_number() over () as row, doc_id, coalesce(text, '') as t,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    g as (select row, i, list_slice(w, i, i + 7) as win
          from (select row, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
    again as (select row, count(distinct p) as n from (
                select row, unnest(range(i, i + 8)) as p
                from (select row, i, count(*) over (partition by row, win) as n from g) where n > 1) group by row),
    lines as (select row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
              from d),
    m as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
            len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines,
            length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
            len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_run_words
          from d join lines using (row) left join again using (row)),
    b as (select *, (case when n_words < 20 then 1 else 0 end)
            + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
            + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end)
            + (case when 100 * n_upper > 30 * word_chars then 8 else 0 end)
            + (case when 100 * n_dup_lines > 30 * n_lines then 16 else 0 end)
            + (case when 100 * n_run_words > 20 * n_words then 32 else 0 end)
            + (case when word_chars < 2 * n_words then 64 else 0 end)
            + (case when word_chars > 20 * n_words then 128 else 0 end) as f from m)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
      cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
      cast(n_repeat_words as bigint) as n_repeat_words, f & 3 <> 0 as base_failed,
      (f & 47 = 0) and bit_count(f & 208) <= 1 as kept, cast(f as bigint) as failed_bits,
      cast(n_lines as bigint) as n_lines, cast(n_upper as bigint) as n_upper,
      cast(n_run_words as bigint) as n_run_words
    from b"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can state: the others hash, learn, or call a tokenizer,
    and are held against plain versions in tests/llm."""
    return {"op9_benchmark_decontamination": _ORACLE_9, "op11_filter_interaction_audit": _ORACLE_11,
            "op12_hard_negative_mining": _ORACLE_12, "op13_quality_rules": _ORACLE_13}
