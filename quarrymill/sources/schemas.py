"""Explicit schemas. A map is never left to inference: its keys would become columns."""

from __future__ import annotations

ARCHIVE_EVENT = "repo struct<name:string>"

REPOSITORY = (
    "name string, metadata struct<created_at:string, stargazers_count:bigint, size:bigint, language:string, description:string, url:string,"
    " full_name:string, name:string, html_url:string, default_branch:string, forks_count:bigint, watchers_count:bigint, open_issues_count:bigint,"
    " owner:struct<login:string>>, contributors_data map<string, struct<contributions:bigint, emails:array<string>>>,"
    " file_tree_data array<struct<path:string, type:string>>, file_tree_truncated boolean, recent_commits_count_3_months bigint,"
    " commits array<struct<sha:string, committer_id:string, committer_email:string, date:string, filenames:array<string>>>"
)

REPORT = (
    "summary struct<repository_name:string, detected_patterns:array<string>, total_patterns_scanned:bigint, timestamp:string, run_id:string>,"
    " patterns map<string,boolean>, scanned_files_per_pattern map<string,array<string>>,"
    " _metadata struct<experiment:struct<run_number:bigint, phase:string>, reproducibility:struct<configuration:struct<thresholds:struct<high_priority:double,"
    " medium_priority:double, min_priority_score:double, judge_confidence:bigint>, weight_scheme:string, random_seed:bigint>>,"
    " models:map<string,string>, priority_weights:map<string,double>, source_log:string>"
)

#: Kinds of events in a detection log.
EVENT_KINDS = (
    "run_summary", "session_start", "session_end", "pattern_analysis_start", "pattern_analysis_end", "file_scored",
    "prioritization_complete", "file_investigated", "evidence_accepted", "investigation_phase_complete", "deliberation_start",
    "pattern_verdict", "error", "warning", "performance_metric", "llm_call", "graph_built", "graph_stats", "negative_evidence",
)

DETECTION_EVENT = (
    "timestamp string, level string, logger string, message string, event string, run_id string, session_id string, start_time string,"
    " configuration map<string,string>, duration_seconds double, success boolean, total_patterns bigint, detected_patterns bigint, detection_rate double,"
    " pattern string, candidate_files bigint, evidence_count bigint, detected boolean, file string, priority_score double, keyword_score double,"
    " embedding_score double, graph_score double, parser_score double, llm_score double, anti_keywords_count bigint, total_files bigint,"
    " high_priority bigint, medium_priority bigint, low_priority bigint, is_evidence boolean, confidence double, reasoning string, snippet string,"
    " phase string, files_analyzed bigint, evidence_found bigint, confidence_score double, evidence_files array<string>, false_positive_risk string,"
    " rejection_reason string, provider string, model string, operation string, tokens map<string,bigint>, nodes bigint, edges bigint,"
    " node_types map<string,bigint>, edge_types map<string,bigint>, context string, error_type string, error_message string, warning_message string"
)

PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
