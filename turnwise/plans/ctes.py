"""Shared parts of the checking SQL, written against the given tables alone."""

TOK = "'[^ \\n]+'"

#: The beam of the path queries: steps, successors and live paths, nodes that are kept of a root.
BEAM_DEPTH, BEAM_WIDTH, BEAM_BEST = 5, 10, 24


def _level(depth: int) -> str:
    """Step ``depth`` of the beam: all successors of the paths that live on."""
    return f"""
        SELECT root, list_append(ranks, r) AS ranks, list_append(tokens, nxt) AS tokens, nxt AS tail, score + lp AS score,
            row_number() OVER (PARTITION BY root ORDER BY round(score + lp, 9) DESC, list_append(ranks, r)) - 1 AS rank,
            z.rank AS parent_rank, r AS child_rank, {depth} AS depth
          FROM z_d{depth - 1} z JOIN z_succ ON token = tail WHERE z.rank < {BEAM_WIDTH}"""


CTES = {
    "z_norm": """
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS j,
               CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS speaker,
               CASE WHEN turn = 1 AND first_role = 'system' THEN first_text || text ELSE text END AS value
        FROM (SELECT *, first_value(role) OVER w AS first_role, first_value(text) OVER w AS first_text
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE NOT (turn = 0 AND role <> 'user')""",
    "z_tok": f"""
        SELECT conv_id, j, speaker, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
        FROM (SELECT *, regexp_extract_all(value, {TOK}) AS toks FROM z_norm)""",
    "z_count": """
        SELECT token, count(*) AS n_all,
               count(*) FILTER (speaker = 'gpt' AND NOT (j = 0 AND pos = 0)) AS n_target
        FROM z_tok GROUP BY token""",
    "z_ids": "SELECT token, n_all, n_target, row_number() OVER (ORDER BY token) - 1 AS token_id FROM z_count",
    "z_top": "SELECT token, token_id, n_target FROM z_ids WHERE n_target > 0 ORDER BY n_target DESC, token LIMIT 500",
    "z_map": "SELECT *, row_number() OVER (ORDER BY token_id) - 1 AS draft_id FROM z_top",
    "z_seq": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY j, pos) - 1 AS p, token, speaker
        FROM z_tok""",
    "z_ids_seq": """
        SELECT s.conv_id, s.p // 2048 AS "window", s.p % 2048 AS p, i.token_id,
               CAST(s.speaker = 'gpt' AND s.p % 2048 > 0 AS BIGINT) AS loss_mask,
               count(*) OVER (PARTITION BY s.conv_id, s.p // 2048) AS n
        FROM z_seq s JOIN z_ids i USING (token)""",
    "z_doc": """
        SELECT doc_id, lang, text, s[1] AS instruction, coalesce(s[2], '') AS input,
               coalesce(array_to_string(s[3:], chr(10)), '') AS output
        FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents)""",
    "z_docmsg": """
        SELECT doc_id, m.k AS k, m.role AS role, m.content AS content FROM (
          SELECT doc_id, unnest(CASE doc_id % 5
            WHEN 0 THEN [{'k': 0, 'role': 'system', 'content': input}, {'k': 1, 'role': 'user', 'content': instruction},
                         {'k': 2, 'role': 'assistant', 'content': output}]
            WHEN 1 THEN [{'k': 0, 'role': 'assistant', 'content': input}, {'k': 1, 'role': 'user', 'content': instruction},
                         {'k': 2, 'role': 'assistant', 'content': output}]
            WHEN 2 THEN [{'k': 0, 'role': 'assistant', 'content': output}]
            ELSE [{'k': 0, 'role': 'user', 'content': instruction}, {'k': 1, 'role': 'assistant', 'content': output}]
            END) AS m FROM z_doc)""",
    "z_docconv": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS j,
               CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS speaker,
               CASE WHEN k = 1 AND first_role = 'system' THEN first_content || content ELSE content END AS value
        FROM (SELECT *, first_value(role) OVER w AS first_role, first_value(content) OVER w AS first_content
              FROM z_docmsg WINDOW w AS (PARTITION BY doc_id ORDER BY k))
        WHERE NOT (k = 0 AND role <> 'user')""",
    "z_line": """
        SELECT doc_id, lang, text, doc_id % 17 = 3 AS blank, doc_id % 13 = 5 AS cut, doc_id % 19 = 7 AS keyless,
               CASE WHEN doc_id % 11 <> 0 THEN 'doc-' || doc_id END AS id,
               CASE WHEN doc_id % 19 <> 7 THEN
                 CASE doc_id % 3 WHEN 0 THEN 'prompt' WHEN 1 THEN 'instruction' ELSE 'question' END END AS prompt_key
        FROM documents""",
    "z_loaded": "SELECT * FROM z_line WHERE NOT blank AND NOT cut",
    "z_said": f"""
        SELECT conv_id, turn, text, conv_id * 1000000000 + turn // 4 AS question_id,
               CAST(len(regexp_extract_all(text, {TOK})) AS BIGINT) AS n, 1 + (conv_id + turn) % 4 AS k
        FROM conversations WHERE role = 'assistant'""",
    "z_run": """
        SELECT 'base' AS model_id, 'base-' || question_id AS answer_id, question_id, CAST(question_id AS DOUBLE) AS tstamp,
               turn, text, n AS n_said, n AS new_tokens, n - 1 AS idx, n * 0.025::DOUBLE AS wall_time FROM z_said
        UNION ALL
        SELECT 'draft', 'draft-' || question_id, question_id, CAST(question_id AS DOUBLE), turn, text, n, n,
               CAST(ceil(n / k) - 1 AS BIGINT), ceil(n / k) * 0.03::DOUBLE FROM z_said
        UNION ALL
        SELECT 'draft', 'draft-retry-' || question_id, question_id, CAST(question_id + 1000000 AS DOUBLE), turn, 'ERROR',
               n, 1, 0, 0.03::DOUBLE FROM z_said WHERE conv_id % 10 = 0""",
    "z_log": """
        SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY turn) - 1 AS t,
               row_number() OVER (PARTITION BY answer_id ORDER BY turn DESC) = 1 AS is_last FROM z_run""",
    "z_latest": """
        SELECT * FROM z_log QUALIFY dense_rank() OVER (PARTITION BY model_id, question_id ORDER BY tstamp DESC, answer_id DESC) = 1""",
    "z_speed": """
        SELECT model_id, question_id, CAST(sum(new_tokens) AS BIGINT) AS tokens, sum(wall_time) AS seconds,
               sum(new_tokens) / sum(wall_time) AS rate
        FROM z_latest GROUP BY model_id, question_id""",
    "z_asg": f"""
        SELECT conv_id, turn, regexp_extract_all(text, {TOK}) AS toks,
               CASE WHEN ('0x' || substr(md5(conv_id || ':42'), 1, 8))::BIGINT % 100 < 95 THEN 'train' ELSE 'test' END AS split
        FROM conversations WHERE role = 'assistant'""",
    "z_at": """
        SELECT conv_id, turn, split, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token, toks FROM z_asg""",
    "z_pos": "SELECT conv_id, turn, split, pos, token, toks[pos + 2] AS nxt FROM z_at WHERE pos + 2 <= len(toks)",
    "z_all": "SELECT token, nxt, count(*) AS c FROM z_pos GROUP BY token, nxt",
    "z_train": "SELECT token, nxt, count(*) AS c FROM z_pos WHERE split = 'train' GROUP BY token, nxt",
    "z_rank": """
        SELECT token, nxt, c, row_number() OVER (PARTITION BY token ORDER BY c DESC, nxt) - 1 AS r FROM z_train""",
    "z_best": "SELECT token, nxt FROM z_rank WHERE r = 0",
    "z_mass": "SELECT token, nxt, c, sum(c) OVER (PARTITION BY token) AS total FROM z_all",
    "z_succ": f"""
        SELECT token, nxt, r, ln(c / total) AS lp FROM (
          SELECT *, row_number() OVER (PARTITION BY token ORDER BY c DESC, nxt) - 1 AS r FROM z_mass) WHERE r < {BEAM_WIDTH}""",
    "z_d1": """
        SELECT token AS root, [r] AS ranks, [nxt] AS tokens, nxt AS tail, lp AS score, r AS rank, 0 AS parent_rank,
               r AS child_rank, 1 AS depth FROM z_succ""",
    **{f"z_d{d}": _level(d) for d in range(2, BEAM_DEPTH + 1)},
    "z_nodes": " UNION ALL ".join(f"SELECT * FROM z_d{d}" for d in range(1, BEAM_DEPTH + 1)),
    "z_tree": f"""
        SELECT root, ranks, tokens, depth, score,
               row_number() OVER (PARTITION BY root ORDER BY depth, parent_rank, child_rank) AS node
        FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY round(score, 9) DESC, depth, ranks) AS best FROM z_nodes)
        WHERE best <= {BEAM_BEST}""",
    "z_prefix": """
        SELECT DISTINCT root, ranks[:i] AS prefix, i AS depth
        FROM (SELECT root, ranks, unnest(range(1, len(ranks) + 1)) AS i FROM z_tree)""",
    "z_num": "SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, prefix) AS node FROM z_prefix",
    "z_chain": """
        SELECT a.token, a.nxt AS c1, b.nxt AS c2, c.nxt AS c3, d.nxt AS c4, e.nxt AS c5
        FROM z_best a LEFT JOIN z_best b ON b.token = a.nxt LEFT JOIN z_best c ON c.token = b.nxt
        LEFT JOIN z_best d ON d.token = c.nxt LEFT JOIN z_best e ON e.token = d.nxt""",
    "z_hits": """
        SELECT s.conv_id, s.turn, s.pos, s.split, k,
               CASE WHEN [c1, c2, c3, c4, c5][k] = toks[s.pos + 1 + k] THEN 1 ELSE 0 END AS hit,
               CASE WHEN s.pos + 1 + k <= len(toks) THEN 1 ELSE 0 END AS mask
        FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM z_at) s LEFT JOIN z_chain USING (token)""",
    "z_live": """
        SELECT *, coalesce(min(mask * hit) OVER w, 1) AS live FROM z_hits
        WINDOW w AS (PARTITION BY conv_id, turn, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "z_missed": """
        SELECT *, coalesce(max(live * mask * (1 - hit)) OVER w, 0) AS missed FROM z_live
        WINDOW w AS (PARTITION BY conv_id, turn, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "z_cand": """
        SELECT f.token, f.r AS cand, [f.nxt, h.c1, h.c2, h.c3] AS draft
        FROM z_rank f LEFT JOIN z_chain h ON h.token = f.nxt WHERE f.r < 2""",
    "z_len": """
        SELECT conv_id, turn, pos, cand,
               CASE WHEN coalesce(draft[1] = toks[pos + 2], false) THEN
                 CASE WHEN coalesce(draft[2] = toks[pos + 3], false) THEN
                   CASE WHEN coalesce(draft[3] = toks[pos + 4], false) THEN
                     CASE WHEN coalesce(draft[4] = toks[pos + 5], false) THEN 4 ELSE 3 END
                   ELSE 2 END ELSE 1 END ELSE 0 END AS length
        FROM z_at JOIN z_cand USING (token)""",
    "z_metric": """
        SELECT 'run' || (user_id % 4) AS run, CAST(dayofmonth(ts) AS BIGINT) AS epoch,
               CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, event_id % 3 AS worker,
               event_id AS batch, event_type AS position, least(value / 100, 1.0) AS acc, value AS loss,
               value >= 1.0 AS ok, ts
        FROM events""",
    "z_support": """
        SELECT a.token, a.nxt, a.c / sum(a.c) OVER (PARTITION BY a.token) AS p,
               ln((coalesce(t.c, 0) + 1) / sum(coalesce(t.c, 0) + 1) OVER (PARTITION BY a.token)) AS log_q
        FROM z_all a JOIN z_top v ON v.token = a.nxt LEFT JOIN z_train t ON t.token = a.token AND t.nxt = a.nxt""",
    "z_cross": "SELECT token, -sum(p * log_q) AS h FROM z_support GROUP BY token",
    "z_first": """
        SELECT token, nxt IN (SELECT token FROM z_top) AS inside FROM (
          SELECT token, nxt, row_number() OVER (PARTITION BY token ORDER BY c DESC, nxt) AS r FROM z_all) WHERE r = 1""",
    "z_steploss": """
        SELECT k AS position, sum(CASE WHEN f.inside THEN coalesce(h, 0) ELSE 0 END) / (SELECT count(*) FROM z_at) AS loss,
               count(*) AS n
        FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6]) AS k FROM z_pos) p JOIN z_first f ON f.token = p.token
        LEFT JOIN z_cross x ON x.token = p.token WHERE p.pos >= k GROUP BY k""",
    "z_vbest": """
        SELECT token, nxt FROM (SELECT token, nxt, row_number() OVER (PARTITION BY token ORDER BY c DESC, nxt) AS r
                                FROM z_train WHERE nxt IN (SELECT token FROM z_top)) WHERE r = 1""",
    "z_vchain": """
        SELECT a.token, [a.nxt, b.nxt, c.nxt, d.nxt, e.nxt, f.nxt, g.nxt] AS chain
        FROM z_vbest a LEFT JOIN z_vbest b ON b.token = a.nxt LEFT JOIN z_vbest c ON c.token = b.nxt
        LEFT JOIN z_vbest d ON d.token = c.nxt LEFT JOIN z_vbest e ON e.token = d.nxt
        LEFT JOIN z_vbest f ON f.token = e.nxt LEFT JOIN z_vbest g ON g.token = f.nxt""",
    "z_vhits": """
        SELECT k, CASE WHEN chain[k] = toks[s.pos + 1 + k] THEN 1 ELSE 0 END AS hit,
               CASE WHEN s.pos + 1 + k <= len(toks) THEN 1 ELSE 0 END AS mask
        FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS k FROM z_at) s LEFT JOIN z_vchain USING (token)""",
    "z_draw": """
        SELECT user_id % 15 AS position, least(CAST(floor(value / 4) AS BIGINT), 24) AS bin FROM events""",
    "z_hist": """
        SELECT g.position, g.bin, count(d.bin) / any_value(g.total) AS share FROM (
          SELECT position, total, unnest(range(0, 25)) AS bin FROM (SELECT position, count(*) AS total FROM z_draw GROUP BY 1)) g
        LEFT JOIN z_draw d ON d.position = g.position AND d.bin = g.bin GROUP BY g.position, g.bin""",
    "z_pool": """
        SELECT bin, count(*) / (SELECT count(*) FROM z_draw) AS expected FROM z_draw GROUP BY bin""",
    "z_judge": """
        SELECT s.question_id, any_value(s.conv_id % 3 = 0) AS math, count(*) > 1 AS multi,
               list(coalesce(u.text, '') ORDER BY s.turn) AS q, list(a.text ORDER BY s.turn) AS a, list(b.text ORDER BY s.turn) AS b
        FROM z_said s LEFT JOIN conversations u ON u.conv_id = s.conv_id AND u.turn = s.turn - 1 AND u.role = 'user'
        JOIN z_latest a ON a.model_id = 'base' AND a.question_id = s.question_id AND a.turn = s.turn
        JOIN z_latest b ON b.model_id = 'draft' AND b.question_id = s.question_id AND b.turn = s.turn
        GROUP BY s.question_id""",
    "z_verdict": """
        SELECT a.question_id, a.t, CASE (a.question_id + a.t) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS verdict,
               CAST(1 + a.question_id % 10 AS BIGINT) AS rating
        FROM z_latest a JOIN z_latest b ON b.model_id = 'draft' AND b.question_id = a.question_id AND b.t = a.t
        WHERE a.model_id = 'base'""",
}
