"""Text helpers (fn_regex_numbers, fn_ratio_label, fn_format_id, tokenising)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are Unicode letters and digits, so tokenising behaves the same
# for the four languages in the document tables and in RE2 (the SQL oracle).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# Fixed value: figures quoted in prose -- thousands-grouped integers or numbers
# with one decimal, between word boundaries (of Unicode letters and digits).
FIGURE_PATTERN = r"(?<![\p{L}\p{N}_])(\d{1,3}(?:,\d{3})+|\d+\.\d)(?![\p{L}\p{N}_])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-cased word tokens of a whole text (empty strings removed)."""
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def number_figures(text) -> Column:
    """Array of quoted figures as doubles (commas stripped)."""
    found = F.regexp_extract_all(_c(text), F.lit(FIGURE_PATTERN), 1)
    return F.transform(found, lambda s: F.regexp_replace(s, ",", "").cast("double"))


def may_hold_figures(text) -> Column:
    """Cheap pre-filter: only texts containing a digit can quote a figure, so
    the full figure pattern runs on those alone (same result, less work)."""
    return _c(text).rlike("[0-9]")


def ratio_label(num, den, dp: int = 1) -> Column:
    """``rate% (num / den)``; 'n/a' when the denominator is zero."""
    n, d = _c(num), _c(den)
    rate = F.try_divide(n.cast("double") * 100, d.cast("double"))
    return F.when(rate.isNull(), F.format_string("n/a (%d / %d)", n.cast("long"), d.cast("long"))) \
        .otherwise(F.format_string(f"%.{dp}f%% (%d / %d)", F.round(rate, dp), n.cast("long"),
                                   d.cast("long")))


def format_id(prefix: str, key, width: int = 7) -> Column:
    """Key-derived formatted id such as JR0000042 (no global row numbering)."""
    return F.format_string(f"{prefix}%0{width}d", _c(key).cast("long"))
