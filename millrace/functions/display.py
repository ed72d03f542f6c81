"""Column functions for reports: percentages, durations, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where there is no whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def percent_or(part: Column, whole: Column, default: float) -> Column:
    return F.coalesce(F.round(percent(part, whole)), F.lit(default)).cast("long")


def whole_percent(done: Column, total: Column) -> Column:
    """Integer progress; 0 where nothing is to be done."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("long")


def rate_text(success: Column, total: Column) -> Column:
    rate = percent(success, total)
    return F.when(total == 0, "--").when(success == total, "100%").otherwise(F.format_string("%.0f%%", rate))


def forms_text(success: Column, forms: Column) -> Column:
    """Successful forms of a run in whole percent, '-' where it has none."""
    return F.when(F.coalesce(forms, F.lit(0)) == 0, "-").otherwise(F.concat(F.round(percent(success, forms)).cast("long").cast("string"), F.lit("%")))


def change_percent(now: Column, before: Column) -> Column:
    """Change against the day before in percent; null if that is 0 or missing."""
    return F.when(before != 0, (now - before).cast("double") * 100 / before)


def health(rate: Column) -> Column:
    return F.when(rate >= 80, "good").when(rate >= 50, "warning").otherwise("error")


def duration_text(seconds: Column) -> Column:
    whole = lambda x: F.floor(x).cast("long").cast("string")
    rounded = lambda x: F.round(x).cast("long").cast("string")
    return (
        F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "-")
        .when(seconds < 60, F.concat(rounded(seconds), F.lit("秒")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("分"), rounded(seconds % 60), F.lit("秒")))
        .otherwise(F.concat(whole(seconds / 3600), F.lit("时"), whole((seconds % 3600) / 60), F.lit("分")))
    )


def shortened(c: Column, size: int = 100) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def list_text(names: Column) -> Column:
    """No names, up to three in full, or the first three and the count."""
    n = F.size(names)
    return F.when(n <= 0, "").when(n <= 3, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.format_string(" +%d", n - 3)))


def money(c: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(c, 2))


def clock(c: Column, style: str) -> Column:
    """style: 'short' month, day, hour and minute; 'time'; 'full'; 'day'."""
    patterns = {"short": "MM-dd HH:mm", "time": "HH:mm:ss", "full": "yyyy-MM-dd HH:mm:ss", "day": "MM-dd"}
    return F.date_format(c, patterns[style])
