"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {
    "p1_found": """
        WITH pool_rows AS (
          SELECT DISTINCT arm, schedule_idx, lower(trim(source)) AS s, train_tokens
          FROM schedule_manifest WHERE repeat_id = 0 AND source IS NOT NULL
        ), pools AS (SELECT arm, s, sum(train_tokens) AS pool FROM pool_rows GROUP BY arm, s),
        listed AS (
          SELECT t.arm, t.source, t.target_share, t.max_repeats, coalesce(p.pool, 0) AS pool
          FROM mix_target t LEFT JOIN pools p ON p.arm = t.arm AND p.s = lower(trim(t.source))
        )
        SELECT arm, source FROM (SELECT *, sum(pool) OVER (PARTITION BY arm) AS total FROM listed)
        WHERE max_repeats * pool < target_share * total""",
    "p3_found": """
        WITH r AS (
          SELECT DISTINCT schedule_idx, topic, difficulty_bucket, solution_token_decile, prompt_token_decile
          FROM schedule_manifest WHERE arm = 'dm_large' AND repeat_id = 0
        ), v AS (
          SELECT DISTINCT schedule_idx, 'topic' AS dimension, lower(trim(topic)) AS c FROM r WHERE topic IS NOT NULL
          UNION SELECT DISTINCT schedule_idx, 'difficulty_bucket', lower(trim(difficulty_bucket)) FROM r WHERE difficulty_bucket IS NOT NULL
          UNION SELECT DISTINCT schedule_idx, 'solution_token_decile', CAST(solution_token_decile AS VARCHAR) FROM r WHERE solution_token_decile IS NOT NULL
          UNION SELECT DISTINCT schedule_idx, 'prompt_token_decile', CAST(prompt_token_decile AS VARCHAR) FROM r WHERE prompt_token_decile IS NOT NULL
        ), sizes AS (SELECT dimension, count(DISTINCT schedule_idx) // 4 AS n FROM v GROUP BY dimension),
        counts AS (SELECT dimension, c, count(DISTINCT schedule_idx) AS eligible FROM v GROUP BY dimension, c)
        SELECT t.dimension, t.category
        FROM sample_target t LEFT JOIN sizes s ON s.dimension = t.dimension
        LEFT JOIN counts k ON k.dimension = t.dimension AND k.c = lower(trim(t.category))
        WHERE coalesce(k.eligible, 0) < t.min_rows OR coalesce(k.eligible, 0) < t.target_share * coalesce(s.n, 0)""",
}
