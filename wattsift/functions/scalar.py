"""Scalar functions as column expressions; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift import constants as K


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(x: Column, bands) -> Column:
    """Name of the first band whose inclusive upper bound holds x."""
    out = None
    for top, name in bands[:-1]:
        out = F.when(x <= top, name) if out is None else out.when(x <= top, name)
    return out.when(x.isNotNull(), bands[-1][1])


def level(x: Column) -> Column:
    return band(x, K.LEVELS)


def risk_class(x: Column) -> Column:
    return band(x, K.CLASSES)


def criticality(category: Column) -> Column:
    pairs = [F.lit(v) for item in K.CRITICALITY.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(K.CRITICALITY_DEFAULT))


def daily_mean(kwh: Column, days: Column) -> Column:
    """kWh for each billed day, three decimals, half up."""
    return F.round(kwh.cast("decimal(12,3)") / F.nullif(days, F.lit(0)).cast("decimal(10,0)"), 3).cast("decimal(12,3)")


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def bimester_start(year: Column, number: Column) -> Column:
    return F.make_date(year, number * 2 - 1, F.lit(1))


def bimester_end(year: Column, number: Column) -> Column:
    return F.last_day(F.make_date(year, number * 2, F.lit(1)))


def bimester_code(year: Column, number: Column) -> Column:
    return F.format_string("REAL-%d-B%d", year.cast("int"), number.cast("int"))


def optional_text(x: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(x), F.lit(""))


def optional_number(x: Column) -> Column:
    """Number with decimal comma or point; blank or malformed is null."""
    return F.replace(optional_text(x), F.lit(","), F.lit(".")).try_cast("double")


def clean_neighbourhood(x: Column) -> Column:
    return optional_text(F.regexp_replace(F.trim(x), r"(?i)^B[ \t]\s*", ""))


def iso_date(x: Column) -> Column:
    """A plain ISO date, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def model_name(scope: Column) -> Column:
    return F.concat(F.lit("isolation-forest-"), scope)


def model_version(code: Column) -> Column:
    return F.concat(F.lit("v1-"), F.substring(code, 1, 16), F.lit("-"), F.substring(F.sha2(code, 256), 1, 8))


def circle_radius(n: Column) -> Column:
    return F.least(10 + 4 * F.sqrt(n), F.lit(40.0))


def client_key(tax_id: Column, number: Column) -> Column:
    return F.coalesce(optional_text(tax_id), F.concat(F.lit("S-"), number))


def numeric_reason(x: Column, field: str) -> Column:
    """Why a text is no valid quantity (not a number, negative, over three decimals, too large), or null."""
    value = x.try_cast("decimal(38,10)")
    return (
        F.when(x.isNull(), f"{field}: falta")
        .when(value.isNull(), f"{field}: no es un número")
        .when(value < 0, f"{field}: es negativo")
        .when(value != F.round(value, 3), f"{field}: más de 3 decimales")
        .when(value >= 1_000_000_000, f"{field}: demasiado grande")
    )


def positive_integer_reason(x: Column, field: str, least: int = 1) -> Column:
    value = x.try_cast("long")
    return F.when(x.isNull(), f"{field}: falta").when(~x.rlike(r"^\s*\d+\s*$") | value.isNull(), f"{field}: no es un entero").when((value < least) | (value > 2147483647), f"{field}: fuera de rango")


def json_value(x: Column) -> Column:
    """A JSON text as a VARIANT; null unless the whole text is one value without repeated keys.

    The parser stops behind the first value, so the text is put into an array
    before a string that it can't contain, which must come out as the second of two.
    """
    mark = F.md5(x.cast("binary"))
    whole = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(whole, "$[1]", "string") == mark, F.try_variant_get(whole, "$[0]", "variant"))
