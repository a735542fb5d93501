"""Column-level helpers: pure ``Column -> Column`` builders, all JVM-side."""
from plumbline.functions.dates import (  # noqa: F401
    month_diff, in_year, month_end, month_end_spine, date_text, add_days, days_diff)
from plumbline.functions.stats import (  # noqa: F401
    safe_div, wilson_bounds, poisson_bounds, normal_cdf, Z95, rnd)
from plumbline.functions.text import (  # noqa: F401
    tokens, number_figures, ratio_label, format_id)
