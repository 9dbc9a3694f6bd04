from ranklab.functions.columns import (  # noqa: F401
    DEFAULT_NAME_ALIASES,
    DNF_POSITION,
    PANDAS_NA_STRINGS,
    POINTS_BY_POSITION,
    clean_name,
    first_word_lower,
    guarded_int,
    half_even,
    is_dnf,
    join_labels,
    na_to_null,
    points_for,
    safe_div,
    to_number,
)
