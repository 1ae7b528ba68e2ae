"""Categories: drawdown buckets, stock tags, regime, sentiment, market hours, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numbers import round_up_half

BUCKETS = ("high", "dip", "corr", "bear", "deep")
#: Sessions of the window names.
RANGES = {"1w": 5, "1m": 21, "3m": 63, "6m": 120}


def drawdown_bucket(distance: Column) -> Column:
    """How deep below its all-time high (in per cent) a stock trades."""
    found = F.lit(BUCKETS[-1])
    for limit, name in ((40, "bear"), (20, "corr"), (10, "dip"), (3, "high")):
        found = F.when(distance < limit, F.lit(name)).otherwise(found)
    return found


def stock_tag(is_ath: Column, is_52: Column, wk_break: Column, distance: Column) -> tuple[Column, Column]:
    """(tag, rank) of a stock, strongest first."""
    tag, rank = F.lit("OFF HIGHS"), F.lit(1)
    for n, (here, name) in enumerate(((distance < 10, "NEAR HIGH"), (wk_break, "BREAKOUT"), (is_52, "52W"), (is_ath, "ATH")), 2):
        tag, rank = F.when(here, F.lit(name)).otherwise(tag), F.when(here, F.lit(n)).otherwise(rank)
    return tag, rank


def regime(advances: Column, declines: Column, e20: Column, e50: Column, e200: Column) -> dict[str, Column]:
    """Market regime from the share of advances and the shares above the averages."""
    pct = F.coalesce(F.try_divide(advances * 100.0, advances + declines), F.lit(0.0))
    score = round_up_half(0.4 * pct + 0.28 * e50 + 0.32 * e200)
    name = F.when(score >= 58, "RISK-ON").when(score >= 46, "NEUTRAL").otherwise("RISK-OFF")
    strong = sum(((e >= 50).cast("int") for e in (e20, e50, e200)), F.lit(0))
    return {"pct_adv": pct, "risk_score": score, "regime": name, "strong": strong}


def sentiment(score: Column) -> Column:
    return F.when(score > 0.15, "Positive").when(score < -0.15, "Negative").otherwise("Neutral")


def market_open(at: Column, zone: str = "Asia/Kolkata", opens: int = 555, closes: int = 930) -> Column:
    """Whether a UTC timestamp is inside the weekday session; both minutes are inside."""
    local = F.from_utc_timestamp(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return ~F.dayofweek(local).isin(1, 7) & minute.between(opens, closes)


def window_size(sessions: Column, length: Column) -> Column:
    """Sessions of a window, at least 2 and at most what there is."""
    return F.greatest(F.lit(2), F.least(sessions, length))


def span_label(sessions: Column) -> Column:
    """A rough name for a number of sessions."""
    # The names and how many sessions they reach to.
    names = ((260, "~1 year"), (130, "~6 months"), (70, "~3 months"), (45, "~2 months"), (26, "~1 month"), (11, "~2 weeks"), (5, "~1 week"))
    found = F.concat(round_up_half(sessions / 21.0).cast("string"), F.lit(" months"))
    for limit, name in names:
        found = F.when(sessions <= limit, F.lit(name)).otherwise(found)
    return found


def day_label(date: Column) -> Column:
    """A date as 12 Mar."""
    return F.date_format(date, "d MMM")


def range_label(dates: Column, n: Column) -> Column:
    """The first and last day of the last ``n`` of an array of dates: 12 Mar → 8 Aug; empty without dates."""
    first = F.get(dates, F.greatest(F.lit(0), F.size(dates) - n))
    label = F.concat(day_label(first), F.lit(" → "), day_label(F.element_at(dates, -1)))
    return F.when(F.size(dates) > 0, label).otherwise(F.lit(""))


def window_note(dates: Column, n: Column) -> Column:
    """45 sessions · ~2 months · 12 Mar → 8 Aug."""
    days = range_label(dates, n)
    return F.concat(n.cast("string"), F.lit(" sessions · "), span_label(n), F.when(days != "", F.concat(F.lit(" · "), days)).otherwise(F.lit("")))


def percent_text(x: Column) -> Column:
    """A signed per cent with one decimal."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.1f", x), F.lit("%"))


def rising(x: Column) -> Column:
    """Whether a value is shown as a rise; zero is."""
    return x >= 0


def bar_width(part: Column, total: Column) -> Column:
    """Whole per cent of a bar, ties upwards; 0 where there is nothing."""
    return F.coalesce(round_up_half(F.try_divide(part * 100.0, F.when(total != 0, total))), F.lit(0)).cast("long")


def meter(value: Column, full: Column) -> Column:
    """Per cent of a meter, from 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value / full * 100.0))


def age_label(then: Column, now: Column) -> Column:
    """Minutes, hours or days between two timestamps."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60))
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def price_text(x: Column, decimals: int = 2) -> Column:
    """A price with two decimals and Indian digit groups: 12,34,567.89."""
    plain = F.format_string(f"%.{decimals}f", F.abs(x))
    digits, cents = F.substring_index(plain, ".", 1), F.substring_index(plain, ".", -1)
    head, tail = F.regexp_extract(digits, r"^(\d*?)(\d{1,3})$", 1), F.regexp_extract(digits, r"^(\d*?)(\d{1,3})$", 2)
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+$)", ",")
    body = F.when(head == "", tail).otherwise(F.concat(grouped, F.lit(","), tail))
    return F.concat(F.when(x < 0, "-").otherwise(""), body, F.lit("."), cents)


def amount_text(x: Column) -> Column:
    """An amount in rupees, in crores or lakhs where it is that large, without needless decimals."""
    short = lambda y: F.regexp_replace(F.format_string("%.2f", y), r"\.00$", "")
    plain = F.regexp_replace(price_text(x, 3), r"\.?0+$", "")
    text = F.when(x >= 1e7, F.concat(short(x / 1e7), F.lit(" Cr"))).when(x >= 1e5, F.concat(short(x / 1e5), F.lit(" L"))).otherwise(plain)
    return F.concat(F.lit("₹"), text)


def clean_symbol(raw: Column) -> Column:
    """A symbol trimmed and upper-cased; null where it has other characters or a wrong length."""
    value = F.upper(F.trim(raw))
    return F.when(value.rlike(r"^[A-Z0-9&.\-]{1,24}$"), value)


def with_suffix(symbol: Column, suffix: str = ".NS") -> Column:
    return F.when(symbol.contains("."), symbol).otherwise(F.concat(symbol, F.lit(suffix)))


def without_suffix(symbol: Column, suffix: str = ".NS") -> Column:
    return F.regexp_replace(symbol, suffix.replace(".", r"\.") + "$", "")


def pad_left(values: Column, length: int) -> Column:
    """The last ``length`` values, filled up with zeros on the left."""
    tail = F.slice(values, F.greatest(F.size(values) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0).cast("double"), F.greatest(F.lit(0), length - F.size(values))), tail)


def ticks(values: Column, n: int = 6) -> Column:
    """``n`` evenly spaced elements of an array, first and last included."""
    last = F.size(values) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.least(last, F.floor(i * last / (n - 1) + 0.5).cast("int"))))
