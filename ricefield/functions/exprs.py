"""Column expressions shared by every plan.  All are built-in Spark functions (JVM side,
whole-stage codegen); none is a Python UDF.

Rounding, ratio and key rules follow the reference application's arithmetic exactly:

* ``r2``        Python ``round(x, 2)``: correctly rounded decimal of the binary double,
                half-even on exact ties (2.675 -> 2.67, 0.125 -> 0.12, 0.375 -> 0.38).
* ``ratio0``    ``round(num / den, 2) if den else 0``.
* ``pct_change``old == 0 -> 0 when new == 0 else NULL; otherwise round((new-old)/old*100, 2).
* ``sql_key``   SQL ``LOWER(TRIM(x))`` (trim strips spaces only).
* ``py_key``    Python ``x.strip().lower()`` (strip removes any whitespace).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r2(x) -> Column:
    """Python-compatible ``round(x, 2)``.

    ``format_number`` formats the exact binary value with HALF_EVEN, which is what
    Python's ``round`` does; Spark's own ``round``/``bround`` work on the decimal
    repr and differ on values such as 2.675.  Infinity formats as a symbol, so the
    parse is a ``try_cast`` with the input as fallback.
    """
    x = _c(x)
    text = F.regexp_replace(F.format_number(x, 2), ",", "")
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(text.try_cast("double"), x.cast("double"))
    )


def ratio0(num, den) -> Column:
    """``round(num / den, 2) if den else 0`` (zero denominator gives 0, never an error)."""
    num, den = _c(num), _c(den)
    return F.when(den.isNotNull() & (den != 0), r2(num / den)).otherwise(F.lit(0.0))


def ratio_pos(num, den) -> Column:
    """Unrounded ``num / den if den > 0 else 0`` (the highlight yield ranks on this)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def pct_change(old, new) -> Column:
    old, new = _c(old), _c(new)
    return F.when(
        old == 0, F.when(new == 0, F.lit(0.0)).otherwise(F.lit(None).cast("double"))
    ).otherwise(r2((new - old) / old * 100))


def trend(diff) -> Column:
    """increased / decreased / no change."""
    diff = _c(diff)
    return F.when(diff > 0, "increased").when(diff < 0, "decreased").otherwise("no change")


def change_marker(change) -> Column:
    """Presentation marker for a percent change: up, down, flat or N/A."""
    change = _c(change)
    return (
        F.when(change.isNull(), "N/A")
        .when(change > 0, F.concat(F.lit("▲ "), F.format_string("%.2f", change), F.lit("%")))
        .when(change < 0, F.concat(F.lit("▼ "), F.format_string("%.2f", change), F.lit("%")))
        .otherwise("▬ 0%")
    )


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace and the four
    separator controls U+001C..U+001F, which Python counts as whitespace."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sql_key(x) -> Column:
    return F.lower(F.trim(_c(x)))


def py_key(x) -> Column:
    return F.lower(py_strip(x))


def full_name(last="last_name", first="first_name", middle="middle_name") -> Column:
    """``TRIM(COALESCE(last,'') || ', ' || COALESCE(first,'') || ' ' || COALESCE(middle,''))``."""
    return F.trim(
        F.concat(
            F.coalesce(_c(last), F.lit("")),
            F.lit(", "),
            F.coalesce(_c(first), F.lit("")),
            F.lit(" "),
            F.coalesce(_c(middle), F.lit("")),
        )
    )


def production_kg(sacks="sacks", kg="kg") -> Column:
    """Per-row production ``sacks * kg``; NULL when either factor is NULL (drops out of sums)."""
    return _c(sacks) * _c(kg)


def mt(kg_sum) -> Column:
    """``COALESCE(SUM(sacks*kg), 0) / 1000.0``."""
    return F.coalesce(_c(kg_sum), F.lit(0.0)) / 1000.0


def like_term(term: str) -> str:
    """``%term%`` with the term used as typed: ``%`` and ``_`` stay wildcards.

    The reference binds the raw term into ``LIKE``, where a backslash is an ordinary
    character.  Spark's ``LIKE`` treats ``\\`` as its escape, so it is doubled.
    """
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_any(columns, term: str, case_sensitive: bool = False) -> Column:
    """``c1 LIKE '%t%' OR c2 LIKE '%t%' ...`` (ILIKE unless case_sensitive)."""
    pattern = like_term(term)
    preds = [(_c(c).like(pattern) if case_sensitive else _c(c).ilike(pattern)) for c in columns]
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


# Cell texts a spreadsheet reader treats as missing (pandas' default
# NA strings); matched on the raw cell, before stripping.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Decimal number as accepted by a numeric coercion of text: optional sign, digits with
# optional fraction (or a bare fraction), optional exponent; surrounding whitespace allowed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TOKENS_SQL = ", ".join(_sql_str(t) for t in MISSING_TOKENS)


def text_or_blank(x) -> Column:
    """Stripped text; NULL and the missing-value tokens become ''.

    Given a column name, the expression is built as one SQL expression (one call into
    the JVM instead of one per token)."""
    if isinstance(x, str):
        c = f"CAST(`{x}` AS STRING)"
        return F.expr(
            f"CASE WHEN {c} IS NULL OR {c} IN ({_TOKENS_SQL}) THEN '' "
            f"ELSE regexp_replace({c}, '(?U)^[\\\\s\\\\x1c-\\\\x1f]+|[\\\\s\\\\x1c-\\\\x1f]+$', '') END"
        )
    raw = _c(x).cast("string")
    return F.when(raw.isNull() | raw.isin(MISSING_TOKENS), F.lit("")).otherwise(py_strip(raw))


def number_or_zero(x) -> Column:
    """Numeric text -> double, anything else (blank, '1,200', 'x', '12d', 'nan') -> 0.0."""
    if isinstance(x, str):
        c = f"CAST(`{x}` AS STRING)"
        pattern = NUMBER_PATTERN.replace("\\", "\\\\")
        return F.expr(
            f"coalesce(nanvl(CASE WHEN {c} RLIKE '{pattern}' THEN try_cast(trim({c}) AS DOUBLE) END, 0D), 0D)"
        )
    s = _c(x).cast("string")
    v = F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


# What Python's ``float`` reads: digits may be grouped by single underscores; signed
# infinities and nan by name.
_DIGITS = r"\d+(_\d+)*"
FLOAT_PATTERN = rf"^[+-]?(({_DIGITS})\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"


def form_number(x) -> Column:
    """``float(x or 0)`` of a form value: NULL and '' are 0, NULL when ``float`` would fail
    (blanks only, '12d', '1,200', 'x').  Around a number ``float`` skips Unicode white space,
    but not the four separator controls that ``str.strip`` also takes off."""
    s = _c(x).cast("string")
    t = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    word = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(s.isNull() | (s == ""), F.lit(0.0))
        .when(t.rlike(FLOAT_PATTERN), F.regexp_replace(t, "_", "").try_cast("double"))
        .when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(word == "nan", F.lit(float("nan")))
    )


def display_or(x, default: str = "-") -> Column:
    """``x or '-'`` for text columns (NULL or '' shows the default)."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


# Latin-1 letters and their ASCII base letters (Unicode NFKD decomposition without the
# combining marks), generated once by a rule rather than listed by hand.
def _latin1_ascii():
    import unicodedata

    src, dst = [], []
    for code in range(0xC0, 0x100):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _latin1_ascii()


def slug(x) -> Column:
    """Export file stem: ``name.lower().replace(' ', '_')`` made file-name safe: accented
    Latin letters to their base letter, whitespace runs to '_', other characters outside
    ``[A-Za-z0-9_.-]`` removed, leading/trailing '.' and '_' stripped."""
    s = F.translate(F.lower(_c(x)), _ACCENTED, _BASE)
    s = F.regexp_replace(s, " ", "_")
    s = F.regexp_replace(py_strip(s), r"(?U)\s+", "_")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_.-]", "")
    return F.regexp_replace(s, r"^[._]+|[._]+$", "")
