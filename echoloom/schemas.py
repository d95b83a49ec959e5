"""Table schemas. Times are naive UTC; ids are strings derived from natural keys."""

TABLES = {
    "raw_feedback": (
        "id string, source_type string, source_id string, url string, title string, content string, author string, "
        "author_url string, timestamp timestamp_ntz, raw_metadata map<string,string>, language string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "processed_documents": (
        "id string, raw_feedback_id string, source_type string, title string, body string, author string, "
        "timestamp timestamp_ntz, url string, language string, word_count int, processing_status string, "
        "feedback_type string, severity_score double, component string, version string, confidence_score double, "
        "classification_metadata struct<type_confidence:double,severity_confidence:double,component_confidence:double,"
        "keywords:array<string>,sentiment:string,urgency_indicators:array<string>,model_version:string>, "
        "embedding array<float>, cluster_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "clusters": (
        "id string, title string, summary string, feedback_type string, component string, avg_severity double, "
        "member_count bigint, centroid_embedding array<double>, similarity_threshold double, created_at timestamp_ntz"
    ),
    "cluster_memberships": "cluster_id string, document_id string, similarity_score double, is_representative boolean",
    "prioritization_scores": (
        "document_id string, cluster_id string, severity_score double, reach_score double, recency_score double, "
        "persona_weight double, priority_score double, priority_level int, is_revenue_critical boolean, "
        "revenue_impact_multiplier double, reasoning array<string>, scoring_version string, created_at timestamp_ntz"
    ),
    "tickets": (
        "id string, source_document_id string, cluster_id string, external_id string, external_url string, platform string, "
        "title string, description string, acceptance_criteria string, repro_steps string, status string, priority int, "
        "labels array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, last_synced_at timestamp_ntz"
    ),
    "feedback_loop_data": (
        "ticket_id string, engineer_label string, engineer_notes string, actual_severity double, resolution_time_hours double, "
        "effort_estimate double, actual_effort double, was_prioritized_correctly boolean, scoring_accuracy double"
    ),
    "agent_executions": (
        "agent_name string, execution_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, "
        "duration_seconds double, items_processed bigint, items_successful bigint, items_failed bigint, error_message string, "
        "error_details string, memory_usage_mb double, cpu_usage_percent double"
    ),
    "system_config": "config_key string, config_value map<string,string>, version int, is_active boolean",
    "digest_reports": (
        "report_type string, title string, content string, summary string, period_start timestamp_ntz, period_end timestamp_ntz, "
        "format string, top_clusters array<struct<id:string,title:string,size:bigint>>, created_at timestamp_ntz"
    ),
    "scheduled_jobs": (
        "id string, name string, workflow_name string, schedule_type string, schedule_value string, timezone string, "
        "enabled boolean, max_concurrent int, timeout int, status string"
    ),
    "job_executions": (
        "job_id string, execution_id string, workflow_name string, status string, started_at timestamp_ntz, "
        "completed_at timestamp_ntz, duration_seconds double, items_processed bigint, items_successful bigint, "
        "items_failed bigint, error_message string, next_run timestamp_ntz"
    ),
}

_USER = "struct<login:string,html_url:string>"
_NAMED = "array<struct<name:string>>"

# landed JSON, one record per line
LANDED = {
    "github_issue": (
        f"id bigint, number bigint, title string, body string, user {_USER}, html_url string, created_at string, "
        f"updated_at string, labels {_NAMED}, state string, comments int, assignees array<struct<login:string>>, "
        "pull_request struct<url:string>, milestone string, locked boolean, reactions string, node_id string"
    ),
    "github_discussion": (
        f"id bigint, number bigint, title string, body string, user {_USER}, html_url string, created_at string, "
        f"updated_at string, labels {_NAMED}, state string, comments int, category string, answer_chosen_at string, "
        "answer_chosen_by string, node_id string"
    ),
    "hacker_news": (
        "id bigint, type string, by string, time bigint, title string, text string, url string, score int, descendants int, "
        "kids array<bigint>, parent bigint, parts array<bigint>, deleted boolean, dead boolean"
    ),
    "exa": (
        "id string, title string, url string, text string, author string, publishedDate string, score double, "
        "domain string, language string, type string"
    ),
    "twitter": (
        "id string, text string, author_id string, created_at string, lang string, "
        "entities struct<hashtags:array<struct<tag:string>>,mentions:array<struct<username:string>>>, "
        "referenced_tweets array<struct<type:string,id:string>>, "
        "public_metrics struct<retweet_count:int,like_count:int,reply_count:int,quote_count:int>, context_annotations string"
    ),
    "twitter_user": (
        "id string, name string, username string, verified boolean, public_metrics struct<followers_count:int>"
    ),
    "reddit_post": (
        "id string, title string, selftext string, author string, permalink string, subreddit string, created_utc double, "
        "score int, upvote_ratio double, num_comments int, is_self boolean, url string, link_flair_text string, domain string, "
        "is_original_content boolean, is_crosspostable boolean, is_reddit_media_domain boolean, is_video boolean, "
        "over_18 boolean, spoiler boolean, stickied boolean, gilded int, distinguished string, post_hint string, "
        "preview string, thumbnail string"
    ),
    "reddit_comment": (
        "id string, body string, author string, permalink string, parent_id string, link_id string, subreddit string, "
        "created_utc double, score int, depth int, is_submitter boolean, gilded int, distinguished string, stickied boolean, "
        "collapsed boolean"
    ),
}
