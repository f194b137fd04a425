"""Column expressions used everywhere: lenient numbers, dates, thresholds, the intraday curve, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, zero: bool = False, kind: str = "double") -> Column:
    """'1,234', '12.5%', ' - ', '--', 'X0.5' to a number; what is none becomes null, or 0 on request."""
    out = F.regexp_replace(F.trim(c), r"[,%\sX]", "").try_cast(kind)
    return F.coalesce(out, F.lit(0).cast(kind)) if zero else out


def roc_date(c: Column) -> Column:
    """'115/04/17' or '1150417' (years since 1911) to a date; null otherwise."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    year = F.substring(digits, 1, 3).try_cast("int") + 1911
    text = F.concat_ws("-", year, F.substring(digits, 4, 2), F.substring(digits, 6, 2))
    return F.when(F.length(digits) == 7, text.try_cast("date"))


def compact_date(c: Column) -> Column:
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("date")


def to_roc(d: Column) -> Column:
    return F.concat(F.year(d) - 1911, F.lit("/"), F.date_format(d, "MM/dd"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_scaled(c: Column, places: int) -> Column:
    """round() of the scaled double, as DuckDB's: it differs from F.round, which goes by the shortest decimal form, in halves."""
    return F.round(c * 10.0**places) / 10.0**places


def lots(shares: Column) -> Column:
    """Shares to lots of 1,000, rounded down also below zero."""
    return F.floor(shares / 1000).cast("long")


# Share of the day's volume done by a minute of the session.
CURVE = ((0, 0.0667), (15, 0.1711), (30, 0.2506), (60, 0.3704), (90, 0.4632), (120, 0.5491), (150, 0.6253), (180, 0.6983), (210, 0.7694), (240, 0.8547), (264, 0.9434), (269, 0.9434), (270, 1.0))


def pct_done(minute: Column, curve: tuple[tuple[int, float], ...] = CURVE) -> Column:
    """Piecewise linear between the curve's points, clamped at its ends."""
    out = F.when(minute >= curve[-1][0], F.lit(curve[-1][1])).when(minute <= curve[0][0], F.lit(curve[0][1]))
    for (m0, p0), (m1, p1) in zip(curve, curve[1:], strict=False):
        out = out.when(minute <= m1, F.lit(p0) + (minute - m0) * ((p1 - p0) / (m1 - m0)))
    return out


def bayes_blend(cum: Column, pct: Column, prior: Column) -> Column:
    """Day forecast: the extrapolated volume weighted by what is done, the prior by the rest."""
    return F.when(pct <= 0, prior).otherwise((cum / pct) * pct + prior * (1 - pct))


def forecast_ci(forecast: Column, pct: Column, z: float = 1.645, spread: float = 0.15) -> tuple[Column, Column]:
    """Interval around a forecast; the whole range without data, none when the day is done."""
    sigma = F.sqrt((1 - pct) / pct) * spread
    low = F.when(pct <= 0, 0.0).when(pct >= 1, forecast).otherwise(F.greatest(F.lit(0.0), forecast * (1 - z * sigma)))
    high = F.when(pct <= 0, forecast * 2).when(pct >= 1, forecast).otherwise(forecast * (1 + z * sigma))
    return low, high


def volume_level(ratio: Column) -> Column:
    return F.when(ratio >= 2.0, "DANGER").when(ratio >= 1.6, "WARN").when(ratio >= 1.3, "OBSERVE").otherwise("NONE")


def session_minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts) - 540


def in_session(ts: Column) -> Column:
    return session_minute(ts).between(0, 270) & (F.weekday(ts) < 5)


def disposition_interval(action: Column) -> Column:
    """Minutes between matchings named in an announcement's text."""
    out = None
    for minutes, words in ((60, ("60分鐘", "六十分鐘")), (45, ("45分鐘", "四十五分鐘")), (25, ("25分鐘", "二十五分鐘")), (20, ("20分鐘", "二十分鐘")), (10, ("10分鐘", "十分鐘")), (5, ("5分鐘", "五分鐘"))):
        hit = F.contains(action, F.lit(words[0])) | F.contains(action, F.lit(words[1]))
        out = F.when(hit, minutes) if out is None else out.when(hit, minutes)
    return out


def restriction_matching(action: Column) -> tuple[Column, Column]:
    """Minutes between matchings and label of a restriction, by its ordinal; null minutes and the text itself for others."""
    rules = (("人工", 60, F.lit("人工管制·每60分撮合")), ("第一次", 5, F.lit("第一次處置·每5分撮合")), ("第二次", 20, F.lit("第二次處置·每20分撮合")), *((w, 20, F.concat(action, F.lit("·每20分撮合"))) for w in ("第三次", "第四次", "第五次")))
    minutes, label = F.when(F.lit(False), 0), F.when(F.lit(False), F.lit(""))
    for word, n, text in rules:
        minutes, label = minutes.when(F.contains(action, F.lit(word)), n), label.when(F.contains(action, F.lit(word)), text)
    return minutes, label.otherwise(action)


def contract_label(contract: Column) -> Column:
    """'202604W2' to '2026/04 W2', '202604' to '2026/04'."""
    week = F.substring(contract, 7, 2)
    return F.concat(F.substring(contract, 1, 4), F.lit("/"), F.substring(contract, 5, 2), F.when(F.length(contract) > 6, F.concat(F.lit(" "), week)).otherwise(""))


# Rating words, first match wins.
RATINGS = (("strong buy", ("strong buy", "強力買進")), ("buy", ("buy", "買進", "overweight", "outperform", "加碼")), ("sell", ("sell", "賣出", "underweight", "underperform", "減碼")), ("hold", ("hold", "neutral", "持有", "中立")))


def rating(c: Column) -> Column:
    text, out = F.lower(c), None
    for name, words in RATINGS:
        hit = None
        for w in words:
            hit = F.contains(text, F.lit(w)) if hit is None else hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def report_name(c: Column) -> tuple[Column, Column, Column]:
    """Type, code and name of 'type_1234_name.pdf'."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([^_]+)_(\d{4})_(.+?)(?:\.\w+)?$", i), F.lit(""))
    return part(1), part(2), part(3)


def regime_label(error: Column, tau: Column) -> tuple[Column, Column, Column]:
    """Label, temperature and capped ratio of a reconstruction error against its threshold; ratio 1 for tau <= 0."""
    ratio = F.when(tau <= 0, 1.0).otherwise(F.least(F.try_divide(error, tau), F.lit(2.0)))
    return F.when(error >= tau, "stress").otherwise("normal"), F.when(tau > 0, F.least(F.lit(100.0), error / tau * 50)), ratio


def last_k_average(values: Column, k: int) -> Column:
    tail = F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k))
    return F.when(F.size(values) > 0, F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail))
