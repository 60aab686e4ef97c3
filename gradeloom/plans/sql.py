"""DuckDB SQL of the core queries."""

from __future__ import annotations

_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _normal(c: str) -> str:
    """The normal form of a question. Of the compatibility characters it knows the full-width forms and blanks."""
    narrow = f"array_to_string(list_transform(string_split({c}, ''), lambda ch: CASE WHEN unicode(ch) BETWEEN 65281 AND 65374 THEN chr(unicode(ch) - 65248) WHEN unicode(ch) = 12288 THEN ' ' ELSE ch END), '')"
    s = f"replace(lower(nfc_normalize({narrow})), 'ß', 'ss')"
    s = rf"replace(regexp_replace({s}, '\\(?:,|!|;|:|quad|qquad)', ' ', 'g'), '$', ' ')"
    s = rf"regexp_replace({s}, '\\(?:left|right)\b', '', 'g')"
    return rf"trim(regexp_replace({s}, '{_BLANKS}+', ' ', 'g'))"


def _template(t: str) -> str:
    """The template of a normal form. RE2 has no look-behind: letters are marked, and digits and signs behind one are hidden from the number pattern."""
    hidden = {c: f"chr({57344 + i})" for i, c in enumerate("0123456789+-")}
    digits, signs = (f"[' || {hidden[a]} || '-' || {hidden[b]} || ']" for a, b in ("09", "+-"))
    s = f"regexp_replace({t}, '([a-z])', '\\1' || chr(1), 'g')"
    for c, to in hidden.items():
        s = f"replace({s}, chr(1) || '{c}', chr(1) || {to})"
    s = f"regexp_replace({s}, '[-+]?[0-9]+(?:[.,][0-9]+)*(?:e' || chr(1) || '(?:{signs}[0-9]+|{digits}[0-9]*))?', ' <num> ', 'g')"
    for c, to in hidden.items():
        s = f"replace({s}, {to}, '{c}')"
    letter = lambda i: f"coalesce(cs[{i}] BETWEEN 'a' AND 'z', false)"
    alone = f"CASE WHEN {letter('i')} AND NOT {letter('i - 1')} AND NOT {letter('i + 1')} THEN ' <var> ' ELSE cs[i] END"
    chars = f"string_split(replace({s}, chr(1), ''), '')"
    return f"(SELECT trim(regexp_replace(array_to_string(list_transform(range(1, len(cs) + 1), lambda i: {alone}), ''), '{_BLANKS}+', ' ', 'g')) FROM (SELECT {chars} AS cs))"


def _variants(rows: str, made: dict[str, str]) -> str:
    """(variant, t) of the texts t as they are and with each change."""
    return "(" + " UNION ALL ".join(f"SELECT '{name}' AS variant, {to} AS t FROM {rows}" for name, to in {"as is": "t", **made}.items()) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _json(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"


_BUCKET = "printf('%.1f', floor(difficulty * 2) / 2)"
_M = "(SELECT DISTINCT * EXCLUDE (arrived_at) FROM schedule_manifest)"
_Q = f"(SELECT DISTINCT train_idx, question, {_normal('question')} AS t FROM dm_large_train)"
_GRAMS = "CASE WHEN t = '' THEN [] WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END"
_FAMILIES = """(SELECT r.*, f.family_hash FROM replay_pool r LEFT JOIN (SELECT source_row_hash, min(source_family_hash) AS family_hash
    FROM schedule_manifest WHERE source_family_hash IS NOT NULL GROUP BY 1) f ON f.source_row_hash = r.row_hash)"""
_OUTCOMES = f"""(SELECT row_hash, input_pos, question_hash, CASE WHEN row_number() OVER w = 1 THEN 'kept'
    WHEN question_hash IS NOT DISTINCT FROM first_value(question_hash) OVER w THEN 'dropped_exact' ELSE 'dropped_family' END AS outcome
    FROM {_FAMILIES} WINDOW w AS (PARTITION BY coalesce(family_hash, question_hash) ORDER BY input_pos))"""
_QUOTA = f"""
    rows AS (SELECT *, {_BUCKET} AS difficulty_bucket FROM prepared_corpus),
    keyed AS (SELECT *, '[' || {_json('topic')} || ',' || {_json('difficulty_bucket')} || ']' AS stratum FROM rows),
    total AS (SELECT count(*) AS big_n, count(*) // 10 AS n FROM rows),
    sizes AS (SELECT stratum, count(*) AS size FROM keyed GROUP BY stratum),
    exact AS (SELECT stratum, size, n, CAST(n AS DOUBLE) * size / CAST(big_n AS DOUBLE) AS e FROM sizes, total),
    ranked AS (SELECT stratum, size, n, floor(e) AS base, row_number() OVER (ORDER BY e - floor(e) DESC, stratum DESC) AS place, sum(floor(e)) OVER () AS given FROM exact),
    quota AS (SELECT stratum, size, CAST(base + CASE WHEN place <= n - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM ranked)"""
_RECORDS = """(SELECT user_id AS idx, event_type AS arm, CAST(v > 10 AS INT) AS fallback_correct, CAST(v > 20 AS INT) AS strict_correct,
    CAST(floor(v * 10) AS BIGINT) AS generated_tokens, CAST(v > 60 AS INT) AS hit_max, CAST(v < 5 AS INT) AS parse_fail FROM (
    SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM (SELECT * FROM events) GROUP BY 1, 2))"""
_PAIRS = f"""(SELECT r.idx, r.arm AS seed, r.fallback_correct AS treat, b.fallback_correct AS base
    FROM {_RECORDS} r JOIN {_RECORDS} b ON b.idx = r.idx AND b.arm = 'view' WHERE r.arm <> 'view')"""
_GAIN = f"(SELECT l.idx, l.fallback_correct AS treat, s.fallback_correct AS base FROM {_RECORDS} l JOIN {_RECORDS} s ON s.idx = l.idx AND s.arm = 'purchase' WHERE l.arm = 'click')"
_INTERVAL = f"""
    pairs AS (SELECT * FROM {_PAIRS}),
    clusters AS (SELECT idx, avg(treat - base) AS value, row_number() OVER (ORDER BY CAST(idx AS VARCHAR)) - 1 AS place FROM pairs GROUP BY idx),
    size AS (SELECT count(*) AS n FROM clusters),
    draws AS (SELECT r.range AS rep, CAST('0x' || substr(md5(r.range || ',' || i.range || ',20260714'), 1, 8) AS BIGINT) % n AS place
      FROM size, range(10000) r, range((SELECT n FROM size)) i),
    means AS (SELECT rep, sum(value) / (SELECT n FROM size) AS mean FROM draws JOIN clusters USING (place) GROUP BY rep),
    ends AS (SELECT quantile_cont(mean, 0.025) AS ci95_low, quantile_cont(mean, 0.975) AS ci95_high FROM means)"""
_SEEDS = f"""(SELECT seed, count(*) AS n, sum(base) / count(*) AS base_acc, sum(treat) / count(*) AS treat_acc, sum(treat - base) / count(*) AS delta,
    count(*) FILTER (base = 0 AND treat = 1) AS improved, count(*) FILTER (base = 1 AND treat = 0) AS regressed FROM {_PAIRS} GROUP BY seed)"""
_WORDS = "list_transform(string_split(coalesce({c}, ''), ' '), lambda w: CAST(length(w) AS BIGINT))"

_PROOF = r"\b(?:prove|show|demonstrate|establish)\s+(?:that|why)\b"
_CHOICE = r"(?:\\text\s*\{?\s*\(?[A-E]\)?\s*\}?\s*[,;]|(?:^|\n)\s*\(?[A-E]\)\s+.*(?:\n\s*\(?[B-E]\)\s+)|\b(?:multiple choice|choose (?:the|an) (?:correct|best)|answer choices?)\b)"
_OPTION = r"(?:^|\s)(?:\\text\s*\{\s*)?\(?[A-E]\)(?:\s*\})?"
_DIAGRAM = r"\b(?:diagram|figure|graph shown|pictured|illustration|shown (?:above|below)|not drawn to scale)\b"
_NON_UNIQUE = r"(?:\b(?:give|provide|construct|find)\s+(?:an|one|some)\s+(?:example|possible|such)\b|\banswers?\s+(?:may|can)\s+vary\b)"
_CUE = r"(?:\b(?:answer|solution)\s*(?:is|:|=)|\\boxed\s*\{)"
_TOOL = r"(?:```|<tool|</tool>|tool[_ -]?(?:call|output)|python\s*(?:code|output)|sympy\.|wolfram|calculator\s*(?:output|result)|execution\s+result)"
_PROMPT = "'Solve the math problem. Please reason step by step, and put your final answer within \\boxed{}.' || chr(10) || chr(10)"

# Fixed values, repeated from the queries: what is added to texts so that the rules hold.
_RESIDUE = ("```", "<tool", "</tool>", "tool-call", "Tool output", "Python code", "pythonoutput", "sympy.", "Wolfram", "calculator result", "execution result", "a tool")
_QUESTION_ENDS = {
    "proof": "Prove that it holds.", "choice": "A) 1\nB) 2\nC) 3", "options": "is it (a) or (b) or (c)", "best": "Choose the best value.", "figure": "as shown above", "example": "Give an example.",
    "vary": "Answers may vary.", "cue": "answer: 5", "box": "\\boxed{3}",
}
_SOLUTION_ENDS = {"boxed": "$\\boxed{\\frac{1}{2}}$.", "open": "\\boxed{1", "after": "\\boxed{1} as wished", "twice": "\\boxed{1} \\fbox{2}", "tool": "```x``` \\boxed{1}"}
_TEXTS = "(SELECT answer AS t FROM (SELECT DISTINCT train_idx, answer FROM dm_large_train) UNION ALL SELECT solution FROM internal_dev UNION ALL SELECT text FROM documents)"
_FINAL = r"(?:final\s+answer(?:\s+is)?|answer(?:\s+is)?|therefore|thus|hence)\s*[:=,-]?\s*"
_LINES = rf"list_filter(list_transform(regexp_split_to_array({{t}}, '\r\n|[\n\r\x{{{{0b}}}}\x{{{{0c}}}}\x{{{{1c}}}}-\x{{{{1e}}}}\x{{{{85}}}}\x{{{{2028}}}}\x{{{{2029}}}}]'), lambda x: regexp_replace(x, '^{_BLANKS.replace('{', '{{').replace('}', '}}')}+|{_BLANKS.replace('{', '{{').replace('}', '}}')}+$', '', 'g')), lambda x: x <> '')"
# texts of v (id, t) that loop
_LOOPS = rf"""folded AS (SELECT id, replace(lower(t), 'ß', 'ss') AS t FROM v WHERE t IS NOT NULL),
      l AS (SELECT id, trim(regexp_replace(unnest(regexp_split_to_array(t, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')), '{_BLANKS}+', ' ', 'g')) AS line FROM folded),
      a AS (SELECT DISTINCT id FROM (SELECT id, line FROM l WHERE length(line) >= 24 GROUP BY 1, 2 HAVING count(*) >= 3)),
      w AS (SELECT id, list_filter(regexp_split_to_array(t, '{_BLANKS}+'), lambda x: x <> '') AS ws FROM folded),
      r AS (SELECT id, unnest(list_transform(range(1, len(ws) - 18), lambda i: hash(ws[i:i + 19]))) AS run FROM w WHERE len(ws) >= 60 AND id NOT IN (SELECT id FROM a)),
      looping AS (SELECT id FROM a UNION SELECT DISTINCT id FROM (SELECT id, run FROM r GROUP BY 1, 2 HAVING count(*) >= 3))"""
# complete boxes of v (id, t): where the command begins, where it should open, where it does and where it closes
_BOXES = r"""braces AS (SELECT id, i, ch, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS depth FROM (
        SELECT id, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS ch FROM (SELECT id, string_split(t, '') AS cs FROM v WHERE t LIKE '%box%')) WHERE ch IN ('{', '}')),
      commands AS (SELECT id, begins, begins + CASE WHEN substr(t, begins, 6) = '\boxed' THEN 6 ELSE 5 END AS inside FROM (
        SELECT id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 6) = '\boxed' OR substr(t, i, 5) = '\fbox')) AS begins FROM v WHERE t LIKE '%box%')),
      opened AS (SELECT c.id, begins, inside, min(i) AS opening, arg_min(depth, i) AS depth FROM commands c JOIN braces b ON b.id = c.id AND b.ch = '{' AND b.i >= c.inside GROUP BY ALL),
      boxes AS (SELECT o.id, begins, inside, opening, min(b.i) AS closing FROM opened o JOIN braces b ON b.id = o.id AND b.i > o.opening AND b.depth = o.depth - 1 GROUP BY ALL)"""

SQL: dict[str, str] = {
    "hamilton_quota": f"WITH {_QUOTA} SELECT stratum, size, quota FROM quota",
    "proportional_take": f"""WITH {_QUOTA}, placed AS (
        SELECT k.row_hash, k.topic, k.difficulty_bucket, q.quota,
          row_number() OVER (PARTITION BY k.stratum ORDER BY sha256('metadata-master-v1:' || k.stratum || chr(0) || k.row_hash), k.row_hash) AS r
        FROM keyed k JOIN quota q USING (stratum))
      SELECT row_number() OVER (ORDER BY sha256('metadata-master-v1:final' || chr(0) || row_hash), row_hash) - 1 AS position, row_hash, topic, difficulty_bucket
      FROM placed WHERE r <= quota""",
    "stratified_round_robin": f"""WITH k AS (SELECT row_hash, topic, '[' || {_json('topic')} || ']' AS s, sha256('round-v1' || chr(0) || row_hash) AS h FROM prepared_corpus),
      t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, row_hash) AS turn FROM k),
      p AS (SELECT row_hash, topic, row_number() OVER (ORDER BY turn, s) - 1 AS position FROM t)
      SELECT position, row_hash, topic FROM p WHERE position < (SELECT count(*) // 10 FROM prepared_corpus)""",
    "token_deciles": """SELECT row_hash,
        CAST(least(9, (10 * (row_number() OVER (ORDER BY assistant_tokens NULLS FIRST, row_hash) - 1)) // count(*) OVER ()) AS INT) AS solution_token_decile,
        CAST(least(9, (10 * (row_number() OVER (ORDER BY prompt_tokens NULLS FIRST, row_hash) - 1)) // count(*) OVER ()) AS INT) AS prompt_token_decile
      FROM prepared_corpus""",
    "stable_positions": "SELECT row_number() OVER (ORDER BY sha256('replay-v1' || chr(0) || row_hash), row_hash) - 1 AS position, row_hash FROM replay_pool",
    "question_hashes": f"SELECT train_idx, sha256(t) AS question_hash FROM {_Q}",
    "exact_duplicates": f"SELECT sha256(t) AS question_hash, count(*) AS copies, min(train_idx) AS first_idx FROM {_Q} GROUP BY 1 HAVING count(*) > 1",
    "ngram_counts": f"SELECT train_idx, CAST(len({_GRAMS}) AS INT) AS n_grams FROM {_Q}",
    "nearest_dev_problem": f"""WITH t AS (SELECT idx, {_normal('problem')} AS t FROM internal_dev), g AS (SELECT idx, {_GRAMS} AS gs FROM t),
      u AS (SELECT idx, len(gs) AS n, unnest(gs) AS g FROM g),
      s AS (SELECT a.idx, b.idx AS ref, count(*) / (a.n + b.n - count(*)) AS score FROM u a JOIN u b ON a.g = b.g AND a.idx <> b.idx GROUP BY a.idx, b.idx, a.n, b.n),
      best AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, ref) AS r FROM s)
      SELECT t.idx, round(coalesce(score, 0), 9) AS score, ref AS nearest_idx FROM t LEFT JOIN best ON best.idx = t.idx AND r = 1""",
    "similar_questions": f"""WITH f AS (SELECT min(train_idx) AS idx, t FROM {_Q} GROUP BY t), g AS (SELECT idx, {_GRAMS} AS gs FROM f),
      u AS (SELECT idx, len(gs) AS n, unnest(gs) AS g FROM g),
      s AS (SELECT a.idx AS train_idx_a, b.idx AS train_idx_b, count(*) / (a.n + b.n - count(*)) AS score FROM u a JOIN u b ON a.g = b.g AND a.idx < b.idx
        AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY a.idx, b.idx, a.n, b.n)
      SELECT train_idx_a, train_idx_b, round(score, 9) AS score FROM s WHERE score >= 0.75""",
    "embedding_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS rank FROM s)
      SELECT query, rank, neighbour, round(c, 6) AS cosine FROM r WHERE rank <= 5""",
    "repetition_loops": rf"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM {_variants('base', {"twice": "coalesce(t, '') || chr(10) || coalesce(t, '')", "thrice": "coalesce(t, '') || chr(10) || coalesce(t, '') || chr(10) || coalesce(t, '')", "thrice in a line": "coalesce(t, '') || ' ' || coalesce(t, '') || ' ' || coalesce(t, '')"}).replace('FROM base', f'FROM {_TEXTS}')}),
      {_LOOPS} SELECT variant, id IN (SELECT id FROM looping) AS loops, count(*) AS n FROM v GROUP BY 1, 2""",
    "tool_residue": f"SELECT variant, regexp_matches(coalesce(t, ''), '{_TOOL}', 'i') AS residue, count(*) AS n FROM {_variants(_TEXTS, {sign: f"concat_ws(' ', t, '{sign}')" for sign in _RESIDUE})} GROUP BY 1, 2",
    "question_rejects": rf"""WITH q AS (SELECT question AS t FROM (SELECT DISTINCT train_idx, question FROM dm_large_train) UNION ALL SELECT problem FROM internal_dev)
      SELECT variant, CASE WHEN regexp_full_match(coalesce(t, ''), '{_BLANKS}*') THEN 'empty_question' WHEN regexp_matches(t, '{_PROOF}', 'i') THEN 'proof_problem'
        WHEN regexp_matches(t, '{_CHOICE}', 'is') OR len(regexp_extract_all(t, '{_OPTION}', 0, 'i')) >= 3 THEN 'multiple_choice'
        WHEN regexp_matches(t, '{_DIAGRAM}', 'i') THEN 'diagram_dependent' WHEN regexp_matches(t, '{_NON_UNIQUE}', 'i') THEN 'non_unique_answer'
        WHEN regexp_matches(t, '{_CUE}', 'i') THEN 'answer_leakage_cue' ELSE 'kept' END AS reason, count(*) AS n
      FROM {_variants("q", {"blank": "' ' || chr(10)", **{name: f"concat_ws(' ', t, {_quoted(end)})" for name, end in _QUESTION_ENDS.items()}})} GROUP BY 1, 2""",
    "solution_rejects": rf"""WITH q AS (SELECT answer AS t FROM (SELECT DISTINCT train_idx, answer FROM dm_large_train) UNION ALL SELECT solution FROM internal_dev),
      p AS (SELECT t, regexp_replace(t, '\\(?:boxed|fbox)', '', 'g') AS b FROM q),
      v AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM {_variants("p", {**{name: f"concat_ws(' ', b, {_quoted(end)})" for name, end in _SOLUTION_ENDS.items()}, "loop": "concat_ws(chr(10), b, b, b, '\\boxed{1}')"})}),
      {_BOXES}, {_LOOPS},
      n AS (SELECT id, count(*) AS n, max(closing) AS last FROM boxes GROUP BY id)
      SELECT variant, CASE WHEN regexp_full_match(coalesce(t, ''), '{_BLANKS}*') THEN 'empty_solution' WHEN len(regexp_extract_all(t, '\\(?:boxed|fbox)\b')) <> coalesce(n, 0) THEN 'truncated_or_unbalanced_box'
        WHEN coalesce(n, 0) <> 1 THEN 'boxed_count_not_one' WHEN regexp_replace(regexp_replace(substr(t, last + 1), '(?:\\\]|\\\)|\$)+', '', 'g'), '[\s.,;:!?]+', '', 'g') <> '' THEN 'text_after_boxed_answer'
        WHEN regexp_matches(t, '{_TOOL}', 'i') THEN 'tool_residue' WHEN id IN (SELECT id FROM looping) THEN 'repetition_loop' ELSE 'kept' END AS reason, count(*) AS n
      FROM v LEFT JOIN n USING (id) GROUP BY 1, 2""",
    "boxed_answers": rf"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, train_idx, answer AS t FROM (SELECT DISTINCT train_idx, answer FROM dm_large_train)), {_BOXES},
      b AS (SELECT id, count(*) AS n, arg_max((begins, inside, opening, closing), begins) AS last FROM boxes GROUP BY id),
      c AS (SELECT id, train_idx, t, n, CASE WHEN n IS NULL THEN '' WHEN last[2] = last[3] THEN regexp_replace(substr(t, last[3] + 1, last[4] - last[3] - 1), '^{_BLANKS}+|{_BLANKS}+$', '', 'g') ELSE substr(t, last[1], last[4] - last[1] + 1) END AS "inner",
          regexp_replace(coalesce(t, ''), '(?:no{_BLANKS}{{0,14}}|without{_BLANKS}{{0,9}}){_FINAL}', ' ', 'gi') AS undenied FROM v LEFT JOIN b USING (id)),
      l AS (SELECT *, regexp_matches(undenied, '{_FINAL}', 'i') AS cue, {_LINES.format(t=f"regexp_extract(undenied, '(?is)^.*{_FINAL}(.*)$', 1)")} AS after, {_LINES.format(t="t")} AS lines FROM c),
      m AS (SELECT *, coalesce(after[1], '') AS said, coalesce(lines[-1], '') AS last_line FROM l),
      r AS (SELECT *, CASE WHEN len(lines) = 0 OR lines IS NULL THEN 'none' WHEN cue THEN CASE WHEN said <> '' AND (regexp_matches(said, '[0-9\\$=+*/^_{{}}\[\]()]') OR (length(said) <= 5 AND said NOT LIKE '% %')) THEN 'explicit_cue' ELSE 'none' END
          WHEN (last_line[1] = '$' AND rtrim(last_line, '. ')[-1] = '$') OR (last_line[1:2] = '\(' AND rtrim(last_line, '. ')[-2:] = '\)') OR (last_line[1:2] = '\[' AND rtrim(last_line, '. ')[-2:] = '\]')
            OR (length(last_line) <= 160 AND NOT regexp_matches(regexp_replace(last_line, '\\[A-Za-z]+', '', 'g'), '[A-Za-z]{{2,}}')) THEN 'standalone_last_line' ELSE 'none' END AS source FROM m)
      SELECT train_idx, CAST(coalesce(n, 0) AS INT) AS n_boxes, "inner", CASE source WHEN 'explicit_cue' THEN said WHEN 'standalone_last_line' THEN last_line ELSE '' END AS terminal, source FROM r""",
    "row_digests": """SELECT row_hash, sha256('{"difficulty":' || coalesce(CAST(difficulty AS VARCHAR), 'null') || ',"final_answer":' || CASE WHEN final_answer IS NULL THEN 'null' ELSE CAST(to_json(final_answer) AS VARCHAR) END
        || ',"prompt_tokens":' || coalesce(CAST(prompt_tokens AS VARCHAR), 'null') || ',"row_hash":' || CAST(to_json(row_hash) AS VARCHAR) || ',"topic":' || CASE WHEN topic IS NULL THEN 'null' ELSE CAST(to_json(topic) AS VARCHAR) END || '}') AS digest
      FROM prepared_corpus""",
    "prompts": rf"""SELECT train_idx, sha256({_PROMPT} || question) AS prompt_sha256, substr(sha1(replace({_PROMPT}, '{{}}', '{{{{}}}}') || '{{q}}'), 1, 12) AS version,
        regexp_replace(regexp_replace(lower(question), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {_Q}""",
    "box_tails": rf"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, answer AS t FROM (SELECT DISTINCT train_idx, answer FROM dm_large_train) WHERE answer IS NOT NULL), {_BOXES},
      f AS (SELECT id, min(closing) AS first_end FROM boxes GROUP BY id), w AS (SELECT id, len(string_split(t, ' ')) AS words, length(array_to_string(string_split(t, ' ')[1:30], ' ')) AS kept FROM v)
      SELECT words > 30 AS cut, coalesce(first_end > kept, false) AS box_lost, count(*) AS n FROM w LEFT JOIN f USING (id) GROUP BY 1, 2""",
    "token_windows": f"""WITH r AS (SELECT train_idx, {_WORDS.format(c='question')} AS p, {_WORDS.format(c='answer')} AS c FROM (SELECT DISTINCT * FROM dm_large_train))
      SELECT train_idx, sha256(CAST(to_json(CASE WHEN len(p) <= 32 THEN p ELSE p[-32:] END) AS VARCHAR)) AS prompt_digest, CAST(CASE WHEN len(p) > 32 THEN 0 ELSE 1 END AS INT) AS expected_bos,
        sha256(CAST(to_json(list_concat(p, c)[1:96]) AS VARCHAR)) AS ids_digest, sha256(CAST(to_json(list_concat(list_transform(p, lambda x: CAST(-100 AS BIGINT)), c)[1:96]) AS VARCHAR)) AS labels_digest,
        CAST(coalesce(list_filter(range(1, len(c) + 1), lambda i: c[i] IN (9, 10))[1], len(c)) AS INT) AS generated, len(p) + len(c) > 96 AS too_long FROM r""",
    "truncation_audit": f"""WITH t AS (SELECT arm, schedule_idx, row_number() OVER (PARTITION BY arm ORDER BY schedule_idx) AS r FROM {_M} WHERE train_tokens > 256)
      SELECT arm, count(*) AS affected, array_to_string(list_sort(list(schedule_idx) FILTER (r <= 20)), ',') AS first_ids FROM t GROUP BY arm""",
    "difficulty_buckets": f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM prepared_corpus GROUP BY 1",
    "topic_distribution": f"""WITH v AS (SELECT arm, 'topic' AS field, coalesce(topic, 'None') AS value FROM {_M} UNION ALL SELECT arm, 'difficulty_bucket', coalesce(difficulty_bucket, 'None') FROM {_M}),
      c AS (SELECT arm, field, value, count(*) AS count FROM v GROUP BY ALL)
      SELECT arm, field, value, count, round(count / sum(count) OVER (PARTITION BY arm, field), 12) AS fraction FROM c""",
    "distribution_gaps": f"""WITH v AS (SELECT arm, unnest(['topic', 'difficulty_bucket', 'solution_token_decile', 'prompt_token_decile']) AS field,
        unnest([coalesce(topic, 'None'), coalesce(difficulty_bucket, 'None'), coalesce(CAST(solution_token_decile AS VARCHAR), 'None'), coalesce(CAST(prompt_token_decile AS VARCHAR), 'None')]) AS value FROM {_M}),
      n AS (SELECT arm, field, value, count(*) AS k FROM v GROUP BY ALL), f AS (SELECT arm, field, value, k / sum(k) OVER (PARTITION BY arm, field) AS x FROM n),
      g AS (SELECT coalesce(a.field, b.field) AS field, max(abs(coalesce(a.x, 0) - coalesce(b.x, 0))) AS gap FROM (SELECT * FROM f WHERE arm = 'dm_small') a
        FULL JOIN (SELECT * FROM f WHERE arm = 'dm_large') b ON a.field = b.field AND a.value = b.value GROUP BY 1)
      SELECT field, round(gap, 12) AS gap, gap <= 0.03 + 1e-12 AS within FROM g""",
    "token_budget": f"""WITH s AS (SELECT unnest(['assistant_tokens', 'prompt_tokens', 'train_tokens']) AS kind,
        unnest([sum(assistant_tokens) FILTER (arm = 'dm_small'), sum(prompt_tokens) FILTER (arm = 'dm_small'), sum(train_tokens) FILTER (arm = 'dm_small')]) AS small,
        unnest([sum(assistant_tokens) FILTER (arm = 'dm_large'), sum(prompt_tokens) FILTER (arm = 'dm_large'), sum(train_tokens) FILTER (arm = 'dm_large')]) AS large FROM {_M})
      SELECT kind, CAST(small AS BIGINT) AS small, CAST(large AS BIGINT) AS large, round(abs(small - large) / greatest(1, small, large), 12) AS gap, abs(small - large) / greatest(1, small, large) <= 0.02 + 1e-12 AS within FROM s""",
    "schedule_composition": f"SELECT arm, source, count(*) AS n, CAST(sum(train_tokens) AS BIGINT) AS train_tokens FROM {_M} GROUP BY 1, 2",
    "replay_deduplicated": f"SELECT row_hash, input_pos, outcome FROM {_OUTCOMES}",
    "replay_audit": f"""SELECT count(*) AS input_rows, count(*) FILTER (outcome = 'kept') AS kept_rows, count(*) FILTER (outcome = 'dropped_exact') AS dropped_exact,
        count(*) FILTER (outcome = 'dropped_family') AS dropped_family, count(DISTINCT question_hash) FILTER (outcome = 'kept') AS kept_questions, count(*) = count(*) FILTER (outcome IN ('kept', 'dropped_exact', 'dropped_family')) AS closed FROM {_OUTCOMES}""",
    "replay_cycle": """WITH o AS (SELECT row_hash, row_number() OVER (ORDER BY sha256('replay-v1' || chr(0) || row_hash), row_hash) - 1 AS place, count(*) OVER () AS n FROM replay_pool)
      SELECT i.range AS exposure, CAST(i.range // n AS INT) AS repeat_id, row_hash FROM range((SELECT count(*) * 5 // 2 FROM replay_pool)) i JOIN o ON o.place = i.range % o.n""",
    "exposures": "SELECT row_hash, train_tokens, 'corpus_large' AS source, CAST(i.range AS INT) AS repeat_id FROM prepared_corpus, range(3) i",
    "schedule_union": """WITH e AS (SELECT 'corpus_large' AS source, train_tokens, NULL AS exposure FROM prepared_corpus, range(3) i), n AS (SELECT count(*) AS n FROM replay_pool),
        o AS (SELECT train_tokens, row_number() OVER () - 1 AS place FROM replay_pool), c AS (SELECT 'math_replay' AS source, NULL AS train_tokens, i.range AS exposure FROM range((SELECT n * 5 // 2 FROM n)) i JOIN o ON o.place = i.range % (SELECT n FROM n))
      SELECT source, count(*) AS n, count(train_tokens) AS with_tokens, count(exposure) AS with_exposure FROM (SELECT * FROM e UNION ALL SELECT * FROM c) GROUP BY source""",
    "corpus_leaks": f"""WITH p AS (SELECT question_hash, family_hash FROM prepared_corpus), r AS (SELECT question_hash, family_hash FROM {_FAMILIES}),
        v AS (SELECT question_hash, sha256({_template('t')}) AS family_hash FROM (SELECT question_hash, {_normal('problem')} AS t FROM internal_dev)), q AS (SELECT sha256(t) AS question_hash, sha256({_template('t')}) AS family_hash FROM {_Q})
      {" UNION ALL ".join(f"SELECT '{name}' AS between, '{kind}' AS kind, (SELECT count(DISTINCT {kind}) FROM {x}) AS distinct_a, (SELECT count(DISTINCT {kind}) FROM {y}) AS distinct_b, (SELECT count(*) FROM (SELECT {kind} FROM {x} WHERE {kind} IS NOT NULL INTERSECT SELECT {kind} FROM {y})) AS shared"
        for name, x, y in (("prepared-replay", "p", "r"), ("prepared-dev", "p", "v"), ("replay-dev", "r", "v"), ("prepared-train", "p", "q")) for kind in ("question_hash", "family_hash"))}""",
    "key_differences": f"""WITH t AS (SELECT DISTINCT CAST(train_idx AS VARCHAR) AS k FROM dm_large_train), s AS (SELECT DISTINCT CAST(schedule_idx AS VARCHAR) AS k FROM {_M} WHERE arm = 'dm_large'),
        u AS (SELECT DISTINCT source_row_hash AS k FROM {_M}), c AS (SELECT row_hash AS k FROM prepared_corpus UNION SELECT row_hash FROM replay_pool),
        m AS (SELECT DISTINCT source_row_hash AS k FROM {_M} WHERE arm = 'dm_small'), g AS (SELECT DISTINCT source_row_hash AS k FROM {_M} WHERE arm = 'dm_large')
      {" UNION ALL ".join(f"SELECT k, 'missing' AS side, '{what}' AS what FROM {x} WHERE k IS NULL OR k NOT IN (SELECT k FROM {y} WHERE k IS NOT NULL) UNION ALL SELECT k, 'extra', '{what}' FROM {y} WHERE k IS NULL OR k NOT IN (SELECT k FROM {x} WHERE k IS NOT NULL)"
        for what, x, y in (("train-schedule", "t", "s"), ("schedule-corpus", "u", "c"), ("small-corpus", "m", "c"), ("small-large", "m", "g")))}""",
    "question_drift": f"""SELECT q.train_idx, 'question' AS against FROM {_Q} q JOIN {_M} m ON m.arm = 'dm_large' AND m.schedule_idx = q.train_idx AND m.source_question_hash IS NOT NULL WHERE sha256(q.t) <> m.source_question_hash
      UNION ALL SELECT q.train_idx, 'family' FROM {_Q} q JOIN {_M} m ON m.arm = 'dm_large' AND m.schedule_idx = q.train_idx AND m.source_family_hash IS NOT NULL WHERE sha256(q.t) <> m.source_family_hash""",
    "template_families": f"SELECT sha256({_template('t')}) AS family_hash, min(train_idx) AS first_idx, count(*) AS members FROM {_Q} GROUP BY 1",
    "dev_containment": f"""WITH d AS (SELECT doc_id, {_normal('text')} AS t FROM documents WHERE text IS NOT NULL), v AS (SELECT idx, {_normal('problem')} AS t FROM internal_dev),
      b AS (SELECT idx, len(gs) AS n, unnest(gs) AS g FROM (SELECT idx, {_GRAMS} AS gs FROM v)), a AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d),
      s AS (SELECT doc_id, idx, count(*) / n AS score FROM a JOIN b USING (g) GROUP BY doc_id, idx, n) SELECT doc_id, idx, round(score, 9) AS score FROM s WHERE score >= 0.9""",
    "question_nearest_dev": f"""WITH q AS (SELECT idx, {_normal('question')} AS t FROM (SELECT min(train_idx) AS idx, question FROM dm_large_train GROUP BY question)), v AS (SELECT idx, {_normal('problem')} AS t FROM internal_dev),
      a AS (SELECT idx, len(gs) AS n, unnest(gs) AS g FROM (SELECT idx, {_GRAMS} AS gs FROM q)), b AS (SELECT idx, len(gs) AS n, unnest(gs) AS g FROM (SELECT idx, {_GRAMS} AS gs FROM v)),
      s AS (SELECT a.idx, b.idx AS ref, count(*) / (a.n + b.n - count(*)) AS score FROM a JOIN b USING (g) GROUP BY a.idx, b.idx, a.n, b.n), best AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, ref) AS r FROM s)
      SELECT q.idx AS train_idx, round(coalesce(score, 0), 9) AS score, ref AS idx FROM q LEFT JOIN best ON best.idx = q.idx AND r = 1""",
    "embedding_leaks": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT a.vec_id, b.vec_id AS nearest, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, nearest) AS r FROM s WHERE c >= 0.3) SELECT vec_id, nearest, round(c, 6) AS cosine FROM r WHERE r = 1""",
    "bin_selection": f"""WITH r AS (SELECT row_hash, CASE WHEN difficulty < 5 THEN 'anchor' WHEN difficulty < 6.5 THEN 'frontier' ELSE 'hard' END AS b, '[' || {_json('topic')} || ']' AS s FROM prepared_corpus),
      a AS (SELECT count(*) FILTER (b = 'anchor') AS aa, count(*) FILTER (b = 'frontier') AS ff, count(*) FILTER (b = 'hard') AS hh, count(*) // 4 AS t FROM r),
      w AS (SELECT *, least(t // 5, hh) AS h0, least(t * 3 // 5, ff) AS f0, least(t - t // 5 - t * 3 // 5, aa) AS a0 FROM a),
      x AS (SELECT *, f0 + least(t - h0 - f0 - a0, ff - f0) AS f1 FROM w), y AS (SELECT *, a0 + least(t - h0 - f1 - a0, aa - a0) AS a1 FROM x),
      q AS (SELECT 'anchor' AS b, a1 AS n, aa AS big FROM y UNION ALL SELECT 'frontier', f1, ff FROM y UNION ALL SELECT 'hard', h0, hh FROM y),
      e AS (SELECT b, s, n, CAST(n AS DOUBLE) * size / CAST(big AS DOUBLE) AS x FROM (SELECT b, s, count(*) AS size FROM r GROUP BY ALL) JOIN q USING (b)),
      k AS (SELECT b, s, n, floor(x) AS base, row_number() OVER (PARTITION BY b ORDER BY x - floor(x) DESC, s DESC) AS place, sum(floor(x)) OVER (PARTITION BY b) AS given FROM e),
      p AS (SELECT r.*, base + CASE WHEN place <= n - given THEN 1 ELSE 0 END AS quota, row_number() OVER (PARTITION BY r.b, r.s ORDER BY sha256('master-' || r.b || ':' || r.s || chr(0) || row_hash), row_hash) AS i FROM r JOIN k USING (b, s))
      SELECT row_number() OVER (ORDER BY sha256('master-final' || chr(0) || row_hash), row_hash) - 1 AS position, row_hash, b AS difficulty_bin FROM p WHERE i <= quota""",
    "nested_membership": f"""SELECT source, coalesce(source_row_hash IN (SELECT source_row_hash FROM {_M} WHERE arm = 'dm_small' AND source_row_hash IS NOT NULL), false) AS in_small, count(*) AS n FROM {_M} WHERE arm = 'dm_large' GROUP BY 1, 2""",
    "bin_counts": """SELECT topic, count(*) AS n, count(*) FILTER (difficulty < 5) AS anchor, count(*) FILTER (difficulty >= 5 AND difficulty < 6.5) AS frontier, count(*) FILTER (difficulty IS NULL OR difficulty >= 6.5) AS hard FROM prepared_corpus GROUP BY 1""",
    "raw_overlap": " UNION ALL ".join(
        f"SELECT '{name}' AS between, (SELECT count(DISTINCT {c}) FROM {a}) AS distinct_a, (SELECT count(DISTINCT {e}) FROM {b}) AS distinct_b, (SELECT count(*) FROM (SELECT {c} FROM {a} WHERE {c} IS NOT NULL INTERSECT SELECT {e} FROM {b})) AS shared"
        for name, a, b, c, e in (
            ("question-problem", "dm_large_train", "internal_dev", "question", "problem"), ("answer-solution", "dm_large_train", "internal_dev", "answer", "solution"), ("text-solution", "documents", "internal_dev", "text", "solution"),
            ("origin-row", "documents", "prepared_corpus", "origin_hash", "row_hash"), ("schedule-row", "schedule_manifest", "prepared_corpus", "source_row_hash", "row_hash"),
        )
    ),
    "single_values": " UNION ALL ".join(
        f"""SELECT arm AS "table", count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'None')) AS "values", (SELECT count(DISTINCT {c}) = 1 AND count(*) = count({c}) FROM {_M} WHERE arm IN ('dm_small', 'dm_large')) AS same, '{c}' AS "column" FROM {_M} WHERE arm IN ('dm_small', 'dm_large') GROUP BY arm"""
        for c in ("split", "arm", "repeat_id")
    ),
    "record_provenance": f"""WITH m AS (SELECT * FROM {_M}), v AS (
        SELECT 'split' AS "column", 'drifted' AS problem, count(*) FILTER (split IS DISTINCT FROM 'train') AS rows FROM m UNION ALL SELECT 'arm', 'drifted', count(*) FILTER (arm IS DISTINCT FROM 'dm_large') FROM m
        UNION ALL SELECT 'ruler_version', 'missing', count(*) FROM m UNION ALL SELECT 'split', 'not single', CASE WHEN count(DISTINCT split) > 1 THEN count(*) ELSE 0 END FROM m
        UNION ALL SELECT 'source', 'not single', CASE WHEN count(DISTINCT source) > 1 THEN count(*) ELSE 0 END FROM m
        {" ".join(f"UNION ALL SELECT '{c}', 'null', count(*) FILTER (trim(coalesce({c}, '')) IN ('', 'None')) FROM m" for c in ("split", "source", "source_row_hash", "topic", "source_question_hash"))})
      SELECT * FROM v WHERE rows > 0""",
    "schedule_report": f"""WITH m AS (SELECT *, source = 'math_replay' AS again, coalesce(source_row_hash, '') AS h, coalesce(source_question_hash, '') AS q, coalesce(source_family_hash, '') AS f FROM {_M} WHERE arm = 'dm_large'),
        k AS (SELECT * FROM m WHERE again AND h <> '' AND q <> '' AND f <> ''), t AS (SELECT DISTINCT train_idx FROM dm_large_train)
      SELECT unnest(['rows', 'replay_rows', 'replay_sources', 'replay_questions', 'replay_families', 'assistant_tokens', 'prompt_tokens', 'train_tokens', 'bad_repeated_positions', 'bad_gaps', 'bad_without_training_row', 'bad_without_schedule_row', 'bad_replay_identity', 'bad_replay_drift']) AS "check",
        unnest([(SELECT count(*) FROM m), (SELECT count(*) FROM m WHERE again), (SELECT count(DISTINCT h) FROM k), (SELECT count(DISTINCT q) FROM k), (SELECT count(DISTINCT f) FROM k), (SELECT CAST(sum(assistant_tokens) AS BIGINT) FROM m),
          (SELECT CAST(sum(prompt_tokens) AS BIGINT) FROM m), (SELECT CAST(sum(train_tokens) AS BIGINT) FROM m), (SELECT count(*) - count(DISTINCT schedule_idx) FROM m), (SELECT max(schedule_idx) + 1 - count(DISTINCT schedule_idx) FROM m),
          (SELECT count(DISTINCT schedule_idx) FROM m WHERE schedule_idx NOT IN (SELECT train_idx FROM t)), (SELECT count(*) FROM t WHERE train_idx NOT IN (SELECT schedule_idx FROM m)), (SELECT count(*) FROM m WHERE again AND (h = '' OR q = '' OR f = '')),
          (SELECT count(DISTINCT (h, q, f)) - count(DISTINCT h) FROM k)]) AS value""",
    "profile_closure": f"""WITH m AS (SELECT source_row_hash AS k, repeat_id FROM {_M} WHERE arm = 'dm_large'), i AS (SELECT row_hash AS k, count(*) AS i FROM prepared_corpus GROUP BY 1), g AS (SELECT k, count(*) AS g FROM m WHERE repeat_id = 0 GROUP BY 1),
        s AS (SELECT k, count(*) AS s, count(*) = 1 AND min(repeat_id) = 1 AND max(repeat_id) = 1 AS c FROM m WHERE repeat_id > 0 GROUP BY 1),
        b AS (SELECT i, g, s, c FROM i FULL JOIN g USING (k) FULL JOIN s USING (k))
      SELECT CASE WHEN i IS NULL THEN 'unknown item' WHEN i > 1 THEN 'repeated item' WHEN g IS NULL AND s IS NULL THEN 'no result' WHEN g IS NULL THEN 'no single result' WHEN g > 1 THEN 'repeated single result'
        WHEN s IS NULL THEN 'no samples' WHEN NOT c THEN 'incomplete samples' ELSE 'closed' END AS status, count(*) AS n FROM b GROUP BY 1""",
    "held_out_check": """WITH s AS (SELECT count(*) AS shared FROM (SELECT question_hash FROM replay_pool WHERE question_hash IS NOT NULL INTERSECT SELECT question_hash FROM internal_dev)), n AS (SELECT count(*) AS held_out_rows FROM internal_dev)
      SELECT held_out_rows, CAST(500 AS BIGINT) AS expected, shared, held_out_rows = 500 AND shared = 0 AS valid FROM n, s""",
    "corpus_ladder": """WITH r AS (SELECT unnest([4.0, 5.0, 0.0, 9.0]::DOUBLE[]) AS low, unnest([8.0, 7.0, 10.0, 10.0]::DOUBLE[]) AS high), c AS (SELECT low, high, (SELECT count(*) FROM prepared_corpus WHERE difficulty >= low AND difficulty < high) AS n FROM r)
      SELECT low, high, n, CASE WHEN n >= 2000 THEN 'ready' WHEN low = 5 AND high = 7 THEN 'widen the range' WHEN n >= 1000 THEN 'ready' ELSE 'too few rows' END AS status,
        CAST(CASE WHEN n >= 2000 THEN 400 WHEN low = 5 AND high = 7 THEN 0 WHEN n >= 1000 THEN 200 ELSE 0 END AS INT) AS small, CAST(CASE WHEN n >= 2000 THEN 2000 WHEN low = 5 AND high = 7 THEN 0 WHEN n >= 1000 THEN 1000 ELSE 0 END AS INT) AS large FROM c""",
    "first_items": "SELECT idx, level, type FROM internal_dev ORDER BY idx LIMIT 4",
    "whole_batches": """WITH i AS (SELECT DISTINCT train_idx FROM dm_large_train), o AS (SELECT train_idx, row_number() OVER (ORDER BY train_idx) AS r, count(*) OVER () AS n FROM i WHERE train_idx % 3 <> 1), k AS (SELECT train_idx FROM o WHERE r <= n - n % 64)
      SELECT (SELECT count(*) FROM k) AS kept, (SELECT max(train_idx) FROM k) AS last_kept, (SELECT count(*) FROM i WHERE train_idx NOT IN (SELECT train_idx FROM k)) AS remaining""",
    "repeat_completeness": f"""WITH g AS (SELECT arm, source_row_hash, count(*) AS r, count(DISTINCT repeat_id) AS s, min(repeat_id) AS a, max(repeat_id) AS b FROM {_M} GROUP BY 1, 2)
      SELECT arm, r = s AND a = 0 AND b = r - 1 AS complete, count(*) AS n, CAST(sum(r) AS BIGINT) AS rows FROM g GROUP BY 1, 2""",
    "source_dependencies": f"""SELECT source_row_hash, count(DISTINCT coalesce(source_question_hash, '-') || '|' || coalesce(source_family_hash, '-')) AS variants
      FROM {_M} WHERE source_row_hash IS NOT NULL GROUP BY 1 HAVING variants > 1""",
    "arm_positions": f"""WITH a AS (SELECT schedule_idx, min(source_row_hash) AS h, min(train_tokens) AS t FROM {_M} WHERE arm = 'dm_small' GROUP BY 1),
        b AS (SELECT schedule_idx, min(source_row_hash) AS h, min(train_tokens) AS t FROM {_M} WHERE arm = 'dm_large' GROUP BY 1)
      SELECT coalesce(a.schedule_idx, b.schedule_idx) AS schedule_idx, CASE WHEN b.schedule_idx IS NULL THEN 'only_a' WHEN a.schedule_idx IS NULL THEN 'only_b' ELSE 'differs' END AS status
      FROM a FULL JOIN b ON a.schedule_idx = b.schedule_idx WHERE a.schedule_idx IS NULL OR b.schedule_idx IS NULL OR a.h IS DISTINCT FROM b.h OR a.t IS DISTINCT FROM b.t""",
    "constant_drift": f"""WITH v AS (SELECT unnest(['split', 'arm', 'repeat_id']) AS "column", unnest(['train', 'dm_large', '0']) AS expected, unnest([split, arm, CAST(repeat_id AS VARCHAR)]) AS value FROM {_M})
      SELECT "column", expected, count(*) AS wrong_rows, array_to_string(list_sort(list(DISTINCT coalesce(value, 'None'))), ',') AS wrong_values FROM v WHERE value IS DISTINCT FROM expected GROUP BY 1, 2""",
    "null_counts": """SELECT unnest(['arm', 'source', 'topic', 'difficulty', 'source_question_hash', 'split']) AS "column", unnest(list_value(count(*), count(*), count(*), count(*), count(*), count(*))) AS rows,
        unnest(list_value(count(*) - count(arm), count(*) - count(source), count(*) - count(topic), count(*) - count(difficulty), count(*) - count(source_question_hash), count(*) - count(split))) AS nulls FROM schedule_manifest""",
    "uniqueness": """SELECT unnest(['row_hash', 'question_hash', 'family_hash']) AS "column", unnest(list_value(count(*), count(*), count(*))) AS rows,
        unnest(list_value(count(DISTINCT row_hash), count(DISTINCT question_hash), count(DISTINCT family_hash))) AS distinct_values,
        unnest(list_value(count(*) = count(DISTINCT row_hash), count(*) = count(DISTINCT question_hash), count(*) = count(DISTINCT family_hash))) AS is_unique FROM prepared_corpus""",
    "duplicate_deliveries": "SELECT arm, schedule_idx, count(*) AS copies FROM schedule_manifest GROUP BY 1, 2 HAVING count(*) > 1",
    "token_limits": """SELECT row_hash, train_tokens FROM prepared_corpus WHERE prompt_tokens IS NULL OR assistant_tokens IS NULL OR train_tokens IS NULL
      OR least(prompt_tokens, assistant_tokens, train_tokens) < 1 OR greatest(prompt_tokens, assistant_tokens, train_tokens) > 300""",
    "record_metrics": f"""SELECT arm, count(*) AS n, CAST(median(generated_tokens) AS DOUBLE) AS median_tokens, count(*) FILTER (strict_correct = 1 AND fallback_correct = 0) AS contract_violations,
        round(sum(strict_correct) / count(*), 9) AS strict_acc, round(sum(fallback_correct) / count(*), 9) AS fallback_acc, round((sum(fallback_correct) - sum(strict_correct)) / count(*), 9) AS format_gap,
        round(sum(generated_tokens) / count(*), 9) AS mean_tokens, round(sum(hit_max) / count(*), 9) AS hit_max_rate, round(sum(parse_fail) / count(*), 9) AS parse_fail_rate FROM {_RECORDS} GROUP BY arm""",
    "arm_comparison": f"""SELECT seed, n, improved, regressed, improved + regressed AS discordant, treat_acc - base_acc >= 0.01 AS passed, improved - regressed >= ceil(0.01 * n - 1e-9) AS passed_exactly,
        round(base_acc, 9) AS base_acc, round(treat_acc, 9) AS treat_acc, round(delta, 9) AS delta,
        round(CASE WHEN improved + regressed = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(improved, regressed) + 1),
          lambda k: exp(lgamma(improved + regressed + 1) - lgamma(k + 1) - lgamma(improved + regressed - k + 1) - (improved + regressed) * ln(2))))) END, 9) AS p FROM {_SEEDS}""",
    "bootstrap_interval": f"""WITH {_INTERVAL} SELECT (SELECT n FROM size) AS n, CAST(10000 AS INT) AS reps, round((SELECT sum(value) FROM clusters) / (SELECT n FROM size), 9) AS estimate,
        round(ci95_low, 9) AS ci95_low, round(ci95_high, 9) AS ci95_high FROM ends""",
    "decision": f"""WITH {_INTERVAL}, seeds AS (SELECT min(delta) AS w, avg(delta) AS m FROM {_SEEDS})
      SELECT w > 0 AND m >= 0.02 AND ci95_low > 0 AS success, round(w, 9) AS worst_delta, round(m, 9) AS mean_delta, round(ci95_low, 9) AS ci95_low, round(ci95_high, 9) AS ci95_high FROM seeds, ends""",
    "diversity": f"""WITH {_INTERVAL.replace("20260714", "20260716").replace(_PAIRS, _GAIN)}
      SELECT (SELECT n FROM size) AS n, CAST(10000 AS INT) AS reps, e >= 0.02 AND ci95_low > 0 AS success, round(e, 9) AS estimate, round(ci95_low, 9) AS ci95_low, round(ci95_high, 9) AS ci95_high
      FROM ends, (SELECT sum(value) / (SELECT n FROM size) AS e FROM clusters)""",
    "level_selection": "SELECT row_number() OVER (ORDER BY sha256('42' || chr(0) || CAST(idx AS VARCHAR)), idx) - 1 AS position, idx, type FROM internal_dev WHERE level = 'Level 4'",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_identities": """WITH g AS (SELECT source_row_hash, count(*) AS r, count(DISTINCT coalesce(source_question_hash, '-') || '|' || coalesce(source_family_hash, '-')) = 1 AS consistent FROM schedule_manifest WHERE source_row_hash IS NOT NULL GROUP BY 1)
      SELECT consistent, count(*) AS n, CAST(sum(r) AS BIGINT) AS rows FROM g GROUP BY 1""",
    "streamed_totals": "SELECT source, count(*) AS rows, CAST(sum(train_tokens) AS BIGINT) AS train_tokens FROM schedule_manifest GROUP BY 1",
}
