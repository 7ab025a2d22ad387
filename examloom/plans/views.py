"""SQL twins of the stand-in views, used as CTEs by the oracles."""

from __future__ import annotations

NOW = "946684800000::BIGINT"

VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it needs, body)
    "v_questions": ("", """
        SELECT p_partkey AS question_id, (2002 + p_size % 22)::INT AS year, (1 + p_partkey % 70)::INT AS number,
          CASE WHEN 1 + p_partkey % 70 <= 20 THEN 'matematica'
               WHEN 1 + p_partkey % 70 <= CASE WHEN 2002 + p_size % 22 <= 2007 THEN 40 ELSE 50 END THEN 'fundamentos'
               WHEN 1 + p_partkey % 70 <= 70 THEN 'tecnologia' ELSE 'desconhecida' END AS area,
          substr('ABCDE', (p_partkey % 5 + 1)::INT, 1) AS answer, p_partkey % 40 = 0 AS annulled,
          CASE WHEN p_size % 7 = 0 THEN []::VARCHAR[] WHEN p_size % 2 = 1 THEN [p_brand]
               ELSE [p_brand, p_type] END AS topics, p_partkey AS bank_pos
        FROM part"""),
    "v_topics": ("", """
        SELECT slug, replace(slug, '#', ' ') AS label,
          CASE WHEN contains(slug, '#') THEN 'fundamentos' ELSE 'tecnologia' END AS area
        FROM (SELECT p_brand AS slug FROM part UNION SELECT p_type FROM part)"""),
    "v_qtopics": ("v_questions", """
        SELECT question_id, year, area, annulled, bank_pos, unnest(topics) AS slug,
          unnest(range(len(topics)))::INT AS tpos FROM v_questions"""),
    "v_sessions": ("", """
        SELECT user_id, session_id, mode, label, created_at,
          CASE WHEN st <> 'P' THEN created_at + 14400000 END AS finished_at, correction_mode, time_limit_seconds,
          elapsed_seconds, CASE WHEN st <> 'P' THEN created_at + 14400000 END AS updated_at
        FROM (SELECT o_custkey AS user_id, o_orderkey AS session_id, lower(substr(o_orderpriority, 3)) AS mode,
          'Prova ' || o_orderkey AS label,
          epoch_us(o_orderdate) // 1000 + o_orderkey % 86400 * 1000 AS created_at, o_orderstatus AS st,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'exam' ELSE 'study' END AS correction_mode,
          CASE WHEN o_orderpriority <> '5-LOW' THEN 14400 END AS time_limit_seconds,
          floor(o_totalprice % 14400)::BIGINT AS elapsed_seconds FROM orders)"""),
    "v_raw_items": ("", """
        SELECT l_orderkey AS session_id,
          (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) - 1)::INT AS pos,
          l_partkey AS question_id,
          CASE l_returnflag WHEN 'A' THEN substr('ABCDE', (l_partkey % 5 + 1)::INT, 1)
               WHEN 'R' THEN substr('ABCDE', ((l_partkey + 1) % 5 + 1)::INT, 1) END AS response,
          l_discount >= 0.08::DOUBLE AS flagged, l_quantity * 8 AS seconds, epoch_us(l_shipdate) // 1000 AS seen_at,
          l_linenumber AS line
        FROM lineitem"""),
    "v_items": ("v_raw_items v_sessions", """
        SELECT i.*, s.user_id, s.created_at, s.finished_at, s.time_limit_seconds
        FROM v_raw_items i JOIN v_sessions s USING (session_id)"""),
    # items joined with the bank, with the correctness predicate
    "v_graded": ("v_items v_questions", """
        SELECT i.*, q.year, q.number, q.area, q.answer, q.annulled, q.topics, q.bank_pos,
          q.annulled OR coalesce(i.response = q.answer, FALSE) AS correct
        FROM v_items i JOIN v_questions q USING (question_id)"""),
    "v_attempts": ("v_graded", """
        SELECT user_id, session_id, question_id, seen_at AS timestamp, response AS answer, correct,
          seconds AS seconds_spent, session_id AS seq, flagged
        FROM v_graded WHERE finished_at IS NOT NULL"""),
    "v_latest": ("v_attempts", """
        SELECT * FROM v_attempts
        QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY timestamp DESC, seq DESC) = 1"""),
    "v_srs": ("v_attempts", """
        SELECT user_id, question_id, repetitions, interval_days, 2.5::DOUBLE AS ease_factor,
          last_reviewed_at + interval_days * 86400000 AS due_at, last_reviewed_at
        FROM (SELECT user_id, question_id, count(*) FILTER (correct) AS repetitions,
          CASE WHEN arg_max(correct, (timestamp, seq)) THEN 6 ELSE 1 END AS interval_days,
          max(timestamp) AS last_reviewed_at FROM v_attempts GROUP BY ALL)"""),
    # schedules of items that have left the bank, which no review may serve
    "v_srs_all": ("v_srs", """
        SELECT * FROM v_srs UNION ALL SELECT * REPLACE (question_id + 1000000000 AS question_id) FROM v_srs WHERE question_id % 7 = 0"""),
    "v_topic_srs": ("v_attempts v_questions", """
        SELECT user_id, slug, repetitions, interval_days, 2.5::DOUBLE AS ease_factor,
          last_reviewed_at + interval_days * 86400000 AS due_at, last_reviewed_at, last_accuracy
        FROM (SELECT user_id, topics[1] AS slug, count(*) FILTER (correct) AS repetitions,
          count(*) % 9 + 1 AS interval_days, max(timestamp) AS last_reviewed_at,
          count(*) FILTER (correct) / count(*) AS last_accuracy
          FROM v_attempts JOIN v_questions USING (question_id) WHERE len(topics) > 0 GROUP BY ALL)"""),
    "v_marks": ("v_attempts", """
        SELECT user_id, question_id, ['erro', 'chute', 'lento', 'duvida'][(question_id % 4 + 1)::INT] AS reason,
          '' AS note, session_id, created_at, updated_at,
          CASE WHEN (user_id + question_id) % 3 = 0 THEN updated_at END AS resolved_at, times_marked
        FROM (SELECT user_id, question_id, arg_max(session_id, (timestamp, seq)) AS session_id,
          min(timestamp) AS created_at, max(timestamp) AS updated_at, count(*) AS times_marked
          FROM v_attempts WHERE flagged GROUP BY ALL)"""),
    "v_events": ("", """
        SELECT event_id, user_id, epoch_us(ts) AS ts_us, (props::JSON ->> '$.k')::INT AS item, event_type AS type, value
        FROM events"""),
    "v_screens": ("", """
        SELECT user_id, session_id, start_us, CASE WHEN st <> 'P' THEN start_us + (session_id % 60 + 1) * 3600000000 END AS end_us,
          limit_seconds
        FROM (SELECT o_custkey AS user_id, o_orderkey AS session_id, o_orderstatus AS st,
          (1704067200 + date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 1080 + o_orderkey % 1080) * 1000000 AS start_us,
          CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 240 + 60 END AS limit_seconds FROM orders)"""),
    "v_screen_events": ("v_events v_screens", """
        SELECT e.*, s.* EXCLUDE (user_id) FROM v_events e LEFT JOIN v_screens s
          ON s.user_id = e.user_id AND s.start_us <= e.ts_us AND (s.end_us IS NULL OR e.ts_us < s.end_us)
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s.start_us DESC NULLS LAST, s.session_id DESC) = 1"""),
}


def with_views(names: str, body: str) -> str:
    """Prefix a query with the CTEs it needs, dependencies first.

    ``body`` may itself start with ``WITH`` (its CTEs are appended to the list).
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0].split():
            visit(dep)
        order.append(name)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if not ctes:
        return body.replace("WITH ", "WITH RECURSIVE ", 1) if body.upper().startswith("WITH ") else body
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"
