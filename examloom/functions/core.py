"""Scalar rules shared by scoring, history, marks and exam assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Item-number ranges per area, and the last year of the older split.
AREA_RANGES = [(1, 20, "matematica"), (21, 50, "fundamentos"), (51, 70, "tecnologia")]
LEGACY_AREA_RANGES = [(1, 20, "matematica"), (21, 40, "fundamentos"), (41, 70, "tecnologia")]
LAST_LEGACY_YEAR = 2007
UNKNOWN_AREA = "desconhecida"

# Display labels.
AREA_LABELS = {
    "matematica": "Matematica",
    "fundamentos": "Fundamentos",
    "tecnologia": "Tecnologia",
    "desconhecida": "-",
}
REASONS = ["erro", "chute", "lento", "duvida"]
REASON_LABELS = {
    "erro": "Errei e nao entendi",
    "chute": "Chutei",
    "lento": "Acertei, mas demorei demais",
    "duvida": "Fiquei em duvida",
}
REASON_SHORT = {"erro": "Erro", "chute": "Chute", "lento": "Lentidao", "duvida": "Duvida"}

# Pacing and absence limits.
PACE_TOLERANCE_SECONDS = 120
MAX_AWAY_SECONDS = 30
MAX_TAB_EXITS = 3
SLOW_FACTOR = 2


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_correct(annulled, response, answer) -> Column:
    """Annulled items are correct whatever was answered; a blank is never correct otherwise."""
    return col(annulled) | F.coalesce(col(response) == col(answer), F.lit(False))


def area_for(number, year) -> Column:
    number, year = col(number), col(year)

    def ranges(table):
        out = F.lit(UNKNOWN_AREA)
        for lo, hi, name in reversed(table):
            out = F.when(number.between(lo, hi), F.lit(name)).otherwise(out)
        return out

    return F.when(year <= LAST_LEGACY_YEAR, ranges(LEGACY_AREA_RANGES)).otherwise(ranges(AREA_RANGES))


def label_of(value, labels: dict[str, str]) -> Column:
    """Label lookup that falls back to the value itself."""
    out = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(out, col(value)), col(value))


def half_up(x: Column) -> Column:
    """Round half up for non-negative input, as BIGINT."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def percent(part, whole) -> Column:
    """Whole percent, 0 when there is nothing to divide by."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def ratio(part, whole) -> Column:
    part, whole = col(part), col(whole)
    return F.when(whole != 0, part.cast("double") / whole)


def clock(seconds) -> Column:
    """HH:MM:SS, negative input clamped to zero."""
    s = F.greatest(F.lit(0), F.floor(col(seconds)))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration(seconds) -> Column:
    """`45s`, `12min` or `1h05min`."""
    s = col(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s < 60, F.format_string("%ds", half_up(s)))
        .when(h > 0, F.format_string("%dh%02dmin", h, m))
        .otherwise(F.format_string("%dmin", m))
    )


def hours_minutes(seconds) -> Column:
    s = col(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh%02dmin", h, m)).otherwise(F.format_string("%dmin", m))


def pace(seconds) -> Column:
    """`3min26s` or `26s`."""
    s = half_up(col(seconds))
    m = F.floor(s / 60)
    return F.when(m > 0, F.format_string("%dmin%02ds", m, s % 60)).otherwise(F.format_string("%ds", s % 60))


def minutes(seconds) -> Column:
    m = half_up(F.abs(col(seconds)) / 60)
    return F.when(m < 1, F.lit("menos de 1 min")).otherwise(F.format_string("%d min", m))


def age(ts, now: int) -> Column:
    days = F.floor((F.lit(now) - col(ts)) / DAY_MS)
    return (
        F.when(days <= 0, F.lit("hoje"))
        .when(days == 1, F.lit("ontem"))
        .otherwise(F.format_string("ha %d dias", days))
    )


def days_until(due_at, now: int) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.ceil((col(due_at) - F.lit(now)) / DAY_MS).cast("bigint"))


def signed(x) -> Column:
    """Two decimals, with a plus sign when positive (display only)."""
    x = col(x)
    return F.when(x > 0, F.format_string("+%.2f", x)).otherwise(F.format_string("%.2f", x))


def local_date(ts_ms, pattern: str = "dd/MM/yyyy") -> Column:
    """Date text in the session time zone."""
    return F.date_format(F.timestamp_millis(col(ts_ms)), pattern)


def target_seconds(limit, questions) -> Column:
    """Seconds per item; null without a limit or without items."""
    limit, questions = col(limit), col(questions)
    return F.when((limit != 0) & (questions != 0), limit / questions)


def pace_delta(elapsed, answered, target) -> Column:
    return col(elapsed) - col(answered) * col(target)


def pace_label(delta) -> Column:
    d = col(delta)
    return (
        F.when(F.abs(d) < PACE_TOLERANCE_SECONDS, F.lit("no ritmo"))
        .when(d > 0, F.concat(minutes(d), F.lit(" atrasado")))
        .when(d <= 0, F.concat(minutes(d), F.lit(" adiantado")))
    )


def suggest_reason(correct, seconds, reference) -> Column:
    return (
        F.when(~col(correct), F.lit("erro"))
        .when(F.coalesce(col(seconds) > col(reference) * SLOW_FACTOR, F.lit(False)), F.lit("lento"))
        .otherwise(F.lit("chute"))
    )


def touched_at(updated_at, finished_at, created_at) -> Column:
    return F.coalesce(col(updated_at), col(finished_at), col(created_at))


def hash_order(seed: str, *cols) -> Column:
    """Repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[col(c).cast("string") for c in cols]))


def hash_int(seed: str, *cols) -> Column:
    """Repeatable 32-bit pseudo-random number, as BIGINT."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("bigint")


def item_id(year, number) -> Column:
    return F.format_string("%d-%02d", col(year), col(number))


def image_path(year, number) -> Column:
    return F.format_string("questions/%d/q%02d.webp", col(year), col(number))


def has_content(text, drawing) -> Column:
    return (F.length(F.trim(col(text))) > 0) | (F.length(col(drawing)) > 0)
