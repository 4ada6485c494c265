from tallyflow.functions.classify import (  # noqa: F401
    DEFAULT_SCHEME,
    EARNING,
    UNBACKED,
    Scheme,
    band_names,
    bucket_of,
    classified,
    coarse_class,
    fine_class,
    folded_class,
    is_unbacked,
    range_band,
    short_key,
    size_band,
)
from tallyflow.functions.clock import at, day_text, hour_text, in_window, moment, month_text, within  # noqa: F401
from tallyflow.functions.numbers import exprs, quoted, sum_if, sum_where, tidied, tidy  # noqa: F401
