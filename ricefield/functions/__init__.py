from ricefield.functions.exprs import (  # noqa: F401
    change_marker,
    contains_any,
    display_or,
    form_number,
    full_name,
    like_term,
    mt,
    number_or_zero,
    pct_change,
    production_kg,
    py_key,
    py_strip,
    r2,
    ratio0,
    ratio_pos,
    slug,
    sql_key,
    text_or_blank,
    trend,
)
