"""Field rules of imports as a table, compiled to column expressions.

A rule says what an absent, a null and a blank value mean, how a value is put
into its stored form, and which limit it must keep.  At this boundary values are
text; absent and null are told apart only for fields with a ``<field>_present``
column.  All reasons of a record are given, in the order of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.functions.scalar import iso_date, json_value, numeric_reason, positive_integer_reason

REQUIRED, OPTIONAL = "required", "optional"


@dataclass(frozen=True)
class Rule:
    """A field's rule.

    ``kind`` is text, number, date, quantity, count or json; ``absent`` says whether
    null is refused, ``default`` what it becomes.  ``blank`` (text only) refuses a
    blank value.  ``stripped``: stored, and measured, without white space around.
    """

    field: str
    kind: str = "text"
    absent: str = OPTIONAL
    limit: int | tuple[float, float] | None = None
    values: tuple[str, ...] = ()
    blank: bool = False
    stripped: bool = False
    default: str | None = None


#: The limits of the stored columns.
CLIENT = (
    Rule("numero_cliente", absent=REQUIRED, limit=30, stripped=True), Rule("nombre", absent=REQUIRED, limit=150, stripped=True),
    Rule("estado", values=("Activo", "Inactivo"), blank=True, default="Activo"), Rule("documento", limit=20), Rule("localidad", limit=100), Rule("barrio", limit=100), Rule("direccion", kind="json", limit=8192),
)
SUPPLY = (
    Rule("numero_suministro", absent=REQUIRED, limit=30, stripped=True), Rule("fecha_alta", kind="date", absent=REQUIRED), Rule("estado", limit=15, blank=True, stripped=True, default="Activo"),
    Rule("localidad", limit=100), Rule("barrio", limit=100), Rule("medidor", limit=20, stripped=True), Rule("latitud", kind="number", limit=(-90, 90)), Rule("longitud", kind="number", limit=(-180, 180)),
)
READING = (Rule("fecha_lectura", kind="date", absent=REQUIRED), Rule("lectura_anterior", kind="quantity", absent=REQUIRED), Rule("lectura_actual", kind="quantity", absent=REQUIRED), Rule("dias_facturados", kind="count", absent=REQUIRED))
BILL = (
    Rule("fecha_inicio", kind="date", absent=REQUIRED), Rule("fecha_fin", kind="date", absent=REQUIRED), Rule("kwh", kind="quantity", absent=REQUIRED),
    Rule("dias_facturados", kind="count", absent=REQUIRED), Rule("consumo_promedio_diario", kind="quantity"),
)

#: White space that counts as blank and is stripped.
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(SPACE))


def json_text(x: Column) -> Column:
    """A JSON text in one form, with sorted keys and without spaces; null if it is none or repeats a key."""
    return F.to_json(json_value(x))


def json_bytes(x: Column, most: int) -> Column:
    """Bytes of a ``json_text`` as it is measured: a space after each comma and colon, and all but printable ASCII escaped.

    Values of over ``most`` bytes without these are not looked at more closely.
    """
    # structural marks are those outside of strings; possessive, so that long strings need no stack
    frame = F.regexp_replace(x, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    spaces = F.length(frame) - F.length(F.translate(frame, ",:", ""))
    beyond = F.regexp_replace(x, r"[\x00-\x7E]++", "")
    astral = F.length(F.regexp_replace(beyond, r"[^\x{10000}-\x{10FFFF}]++", ""))
    escaped = 6 * F.length(beyond) + 6 * astral - F.octet_length(beyond)
    return F.when(F.octet_length(x) > most, F.octet_length(x)).otherwise(F.octet_length(x) + spaces + escaped)


def stored_form(rule: Rule, formed: bool = False) -> Column:
    """The value as it is stored: stripped, in one form, with its default."""
    x = F.col(rule.field)
    if rule.kind == "date":
        x = F.coalesce(iso_date(stripped(x)).cast("string"), x)
    elif rule.kind == "json":
        x = F.coalesce(F.col(f"__form_{rule.field}") if formed else json_text(x), x)
    elif rule.stripped:
        x = stripped(x)
    return F.coalesce(x, F.lit(rule.default)) if rule.default is not None else x


def json_forms(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """The JSON fields in one form, by the name of a helper column: parsed once, however often it is looked at."""
    return {f"__form_{r.field}": json_text(F.col(r.field)) for r in rules if r.kind == "json"}


def _broken(rule: Rule, formed: bool = False) -> list[tuple[Column, str]]:
    """(condition, what it breaks) for a value that is not null, in order; ``formed``: the record has ``json_forms``."""
    x, n = F.col(rule.field), rule.field
    if rule.kind == "date":
        return [(iso_date(stripped(x)).isNull(), f"{n}: inválida")]
    if rule.kind == "number":
        value = x.try_cast("double")
        return [(value.isNull(), f"{n}: no es un número"), (~value.between(*rule.limit), f"{n}: fuera de rango")]
    if rule.kind == "json":
        form = F.col(f"__form_{n}") if formed else json_text(x)
        # a byte is measured as six at most (DEL, escaped), so shorter texts keep the limit whatever they hold
        long = (6 * F.octet_length(form) > rule.limit) & (json_bytes(form, rule.limit) > rule.limit)
        return [(~F.coalesce(form.startswith("{"), F.lit(False)), f"{n}: no es un objeto"), (long, f"{n}: más de {rule.limit} bytes")]
    out = [(stripped(x) == "", f"{n}: vacío")] if rule.blank or rule.absent == REQUIRED else []
    if rule.values:
        out.append((~x.isin(*rule.values), f"{n}: valor no permitido"))
    if rule.limit:
        out.append((F.length(stripped(x) if rule.stripped else x) > rule.limit, f"{n}: más de {rule.limit} caracteres"))
    return out


def reason(rule: Rule, formed: bool = False) -> Column:
    """Why a record's value breaks the rule, or null."""
    if rule.kind in ("quantity", "count"):
        text = (numeric_reason if rule.kind == "quantity" else positive_integer_reason)(F.col(rule.field), rule.field)
        return text if rule.absent == REQUIRED else F.when(F.col(rule.field).isNotNull(), text)
    out = F.when(F.col(rule.field).isNull(), F.lit(f"{rule.field}: vacío" if rule.kind == "text" else f"{rule.field}: falta") if rule.absent == REQUIRED else F.lit(None).cast("string"))
    for condition, text in _broken(rule, formed):
        out = out.when(condition, text)
    return out


def all_reasons(rules: tuple[Rule, ...], formed: bool = False) -> list[Column]:
    return [reason(r, formed) for r in rules]


def stored_forms(rules: tuple[Rule, ...], formed: bool = False) -> dict[str, Column]:
    return {r.field: stored_form(r, formed) for r in rules if r.stripped or r.default is not None or r.kind in ("date", "json")}
