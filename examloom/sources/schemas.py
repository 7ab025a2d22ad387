"""Schemas of the JSON documents the library reads and writes, as DDL text."""

BANK = (
    "generated_at STRING, years ARRAY<INT>, questions ARRAY<STRUCT<id: STRING, year: INT, number: INT, area: STRING, "
    "image: STRING, answer: STRING, annulled: BOOLEAN, topics: ARRAY<STRING>>>"
)
TAXONOMY = "generated_at STRING, topics ARRAY<STRUCT<slug: STRING, label: STRING, area: STRING>>"
SCRATCH = "MAP<STRING, STRUCT<text: STRING, drawing: STRING>>"

_SCHEDULE = "repetitions: INT, intervalDays: DOUBLE, easeFactor: DOUBLE, dueAt: BIGINT, lastReviewedAt: BIGINT"

# everything but the version: field -> type
SNAPSHOT_FIELDS = {
    "sessions": "ARRAY<STRUCT<id: STRING, mode: STRING, label: STRING, createdAt: BIGINT, finishedAt: BIGINT, "
    "correctionMode: STRING, timeLimitSeconds: INT, questionIds: ARRAY<STRING>, responses: MAP<STRING, STRING>, "
    "flagged: MAP<STRING, BOOLEAN>, elapsedSeconds: BIGINT, timePerQuestion: MAP<STRING, DOUBLE>, "
    "absences: ARRAY<INT>, updatedAt: BIGINT>>",
    "attempts": "ARRAY<STRUCT<questionId: STRING, sessionId: STRING, timestamp: BIGINT, answer: STRING, "
    "correct: BOOLEAN, secondsSpent: DOUBLE>>",
    "srs": f"MAP<STRING, STRUCT<questionId: STRING, {_SCHEDULE}>>",
    "topicSrs": f"MAP<STRING, STRUCT<topicSlug: STRING, lastAccuracy: DOUBLE, {_SCHEDULE}>>",
    "marks": "MAP<STRING, STRUCT<questionId: STRING, reason: STRING, note: STRING, sessionId: STRING, createdAt: BIGINT, "
    "updatedAt: BIGINT, resolvedAt: BIGINT, timesMarked: INT>>",
    "deletedSessions": "MAP<STRING, BIGINT>",
}
SNAPSHOT = "version INT, " + ", ".join(f"{k} {v}" for k, v in SNAPSHOT_FIELDS.items())
