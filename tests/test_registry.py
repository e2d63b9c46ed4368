"""Every registered query with SQL returns the same rows as the SQL, on the smallest tables."""
import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
# The larger jobs and those that only chain others are checked in the full comparison (tests/compare.py).
QUICK = ["session_funnel", "daily_active_sessions", "top_viewed_articles", "recommendation_funnel", "clicks_by_rec_source",
         "web_vitals_percentiles", "category_stats", "replace_feedback", "upsert_articles", "normalize_impression", "append_event",
         "tokenize_ko", "split_sentences", "trim_sentences", "classify_source", "parse_news_date", "source_score", "score_trust_table",
         "weight_sensitivity", "binary_metrics", "blend_cross_validation", "hybrid_search", "related_articles", "near_duplicate_pairs",
         "title_similarity_anti_join", "best_candidate_match", "recommend", "encoder_candidates", "temporal_samples", "legacy_samples",
         "offline_replay", "best_weights", "retrieval_metrics", "extractive_highlights", "build_eval_set", "read_jsonl", "read_csv_strings",
         "append_jsonl_resume", "stream_event_log", "stream_impression_batches", "stream_positive_dedupe", "stream_history_state",
         "stream_recommendation_ctr", "stream_web_vitals", "redact_json", "clean_news_body", "greedy_near_dup_in_store", "greedy_near_dup_in_batch",
         "ingest_clean_dedupe", "chunk_invariants", "html_text_squeezed", "append_event_log", "invariant_failures", "embedding_alignment",
         "encode_articles_attention", "weight_grid_search", "near_duplicate_pairs_low_threshold"]


def test_every_query_is_callable_and_sql_belongs_to_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    _, rows, status, detail = compare.check(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() == 4
