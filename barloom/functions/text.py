"""Texts: redaction of secrets, report lines, message chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Patterns of chat-bot URLs and tokens, and what stands in for them.
BOT_URL, BOT_URL_OUT = r"(?i)https://api\.telegram\.org/bot[^/\s]+", "https://api.telegram.org/bot[REDACTED_TOKEN]"
BOT_TOKEN, BOT_TOKEN_OUT = r"\b\d{8,11}:[A-Za-z0-9_-]{35,}\b", "[REDACTED_TOKEN]"


def redact(text: Column, secrets: dict[str, str] | None = None) -> Column:
    """Bot URLs and tokens masked, then the given values longer than 3 characters by their names."""
    out = F.regexp_replace(F.regexp_replace(text, BOT_URL, BOT_URL_OUT), BOT_TOKEN, BOT_TOKEN_OUT)
    for name, value in (secrets or {}).items():
        if len(value) > 3:
            out = F.replace(out, F.lit(value), F.lit(f"[REDACTED_{name}]"))
    return out


def report_line() -> Column:
    """One line of the daily message for a row of the top list."""
    price = lambda c: F.format_number(F.col(c), 0)
    return F.concat_ws(" | ", "ticker", "sector", F.format_string("%.1f", "score"), "signals_fired", price("close"), F.concat(F.lit("SL "), price("STOP_LOSS")), F.concat(F.lit("T1 "), price("TARGET_1")), F.format_string("risk %.1f%%", "RISK_PCT"))


def signed_percent(x: Column | str, places: int = 2) -> Column:
    """A number of percent with its sign, as ``+1.50%``; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.format_string(f"%+.{places}f%%", x))


def day_month_year(day: Column | str) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def weekly_message(day: Column, target: float = 52.0) -> Column:
    """The weekly review of a row of ``tracking.weekly`` with ``regimes``, a text of the last days' regimes; no closed signal has neither rate nor return."""
    rate = F.col("win_rate")
    reached = F.when(rate >= target, F.lit("target met")).otherwise(F.lit("under target"))
    lines = [
        F.concat(F.lit("WEEKLY REVIEW "), day_month_year(day)),
        *[F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in (("New signals", "new_signals"), ("Holding", "holding"), ("Wins", "wins"), ("Losses", "losses"))],
        F.when(rate.isNull(), F.lit("Win rate: nothing closed")).otherwise(F.concat(F.format_string("Win rate: %.1f%% (", rate), reached, F.lit(")"))),
        F.coalesce(F.concat(F.lit("Mean return: "), signed_percent("avg_return")), F.lit("Mean return: no data")),
        F.concat(F.lit("Last regimes: "), F.coalesce("regimes", F.lit("unknown"))),
    ]
    return F.concat_ws("\n", *lines)


def chunks(text: str, most: int = 4000) -> list[str]:
    """A message cut between lines into parts of at most ``most`` characters; a longer line is cut itself."""
    out, now = [], ""
    for line in text.splitlines():
        for part in [line[i : i + most] for i in range(0, len(line), most)] or [""]:
            if now and len(now) + 1 + len(part) > most:
                out.append(now)
                now = part
            else:
                now = f"{now}\n{part}" if now else part
    return [*out, now] if now else out
