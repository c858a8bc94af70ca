from coursemetrics.streaming.events import (engagement_table, run_engagement, run_statements, run_to_table, stream_dedup,
                                            stream_silver)
from coursemetrics.streaming.exact import exact_engagement_table, merged_table, run_exact_engagement, run_merge

__all__ = ["stream_silver", "stream_dedup", "run_to_table", "run_statements", "run_engagement", "engagement_table", "run_exact_engagement",
           "exact_engagement_table", "run_merge", "merged_table"]
