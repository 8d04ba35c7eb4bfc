"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exam_analytics_with_histogram", "d1_teacher_overview", "d3_monitoring_admin", "d8_class_analytics", "d14_student_overview",
    "f2_latest_reports", "b13_report_metrics", "d10_topic_mastery", "d12_submission_analytics", "d13_student_history",
    "d17_question_marks", "e7_award_lines", "c11_verification", "h25_question_confidence", "d25_breakdown",
    "d26_cluster_bootstrap", "d28_outliers", "d29_history_consistency", "e1_segmented_regions", "h31_region_texts",
    "e4_visual_lines", "d27_engine_vote", "e11_paper_questions", "h8_h11_text_evidence", "d17_marks_from_evidence",
    "h19_partial_credit", "h20_autonomous_scores", "h26_explanations", "h27_submission_feedback", "c8_nearest_vectors",
    "c9_lifted_passages", "c10_scheme_against_paper", "h28_redacted_logs", "c4_resolved_questions", "a3_submission_reviews",
    "s2_lifecycle_batch", "s3_lockout_batch",
]


def main() -> None:
    from marklake.plans import registry
    from marklake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    registry.QUERIES["a1_read_entities"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
