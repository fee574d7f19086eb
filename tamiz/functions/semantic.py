"""What a column means, from its name, type and most frequent values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tamiz.functions.names import normal_name

#: Shapes of values, codes for yes and no, and words of column names.
ISO, SLASH = re.compile(r"^\d{4}-\d{2}-\d{2}"), re.compile(r"^(\d{1,2})/(\d{1,2})/(\d{4})$")
EMAIL, PHONE = re.compile(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), re.compile(r"^[+]?[\d\s().-]{7,17}$")
CODE = re.compile(r"^[A-Z]{1,4}-?\d{2,}$")
PERSON = re.compile(r"^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+( [A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3}$")
BOOLEAN = {"si", "sí", "no", "s", "n", "true", "false", "0", "1", "x"}
ORGANISATION = re.compile(r"(?i)fundaci|corporaci|asociaci|cooperativa|s\.?a\.?s|ltda|e\.?s\.?e|alcald|gobernaci|ministerio|universidad")
ORGANISATION_NAMES = ("entidad", "empresa", "organizacion", "institucion", "proveedor", "proyecto", "programa", "producto")
PLACES = ("municipio", "mpio", "muni", "ciudad", "departamento", "dpto", "depto", "vereda", "localidad")
MONEY = ("presupuesto", "valor", "monto", "precio", "importe")
ID_LIKE = re.compile(r"^id$|^id_|_id$|^codigo|^cod_|_key$")


@dataclass
class Meaning:
    kind: str
    confidence: str
    personal: bool = False
    risks: list[str] = field(default_factory=list)


def infer(name: str, group: str, integer: bool, timed: bool, top: list[tuple[str, int]], distinct: int, rows: int, avg_length: float, uniqueness: float) -> Meaning:
    """First rule that fits; ``group`` is numeric, text, date, bool or other, shares are weighed over the top values."""
    n = normal_name(name)
    top = [(str(v), c) for v, c in top if v is not None and str(v).strip()]
    weight = sum(c for _, c in top)
    share = lambda test: sum(c for v, c in top if test(v)) / weight if weight else 0.0
    has = lambda *words: any(re.search(rf"(^|_){w}(_|$)", n) for w in words)
    numeric = group == "numeric"
    if group == "date":
        return Meaning("datetime" if timed else "date", "high")
    iso, slash = share(ISO.match), share(SLASH.match)
    if iso + slash > 0.8:
        parts = [tuple(map(int, m.groups()[:2])) for v, _ in top if (m := SLASH.match(v))]
        risks = []
        if iso > 0 and slash > 0:
            risks.append("mixed_formats")
        if any(a > 12 for a, _ in parts) and any(b > 12 for _, b in parts):
            risks.append("day_first_and_month_first")
        elif parts and all(a <= 12 and b <= 12 for a, b in parts):
            risks.append("ambiguous_day_and_month")
        return Meaning("date", "high" if iso + slash > 0.95 else "medium", risks=risks)
    if has("correo", "email", "mail"):
        return Meaning("email", "high" if share(EMAIL.match) > 0.5 else "low", True)
    if has("telefono", "celular", "movil", "phone"):
        return Meaning("phone", "high" if share(PHONE.match) > 0.5 else "low", True)
    if has("documento", "cedula", "dni"):
        return Meaning("person_document", "high", True)
    if has("direccion"):
        return Meaning("address", "medium", True)
    if "nombre_completo" in n or "nombres_apellidos" in n:
        return Meaning("person_name", "high", True)
    if has(*PLACES) or "municipio" in n or "departamento" in n:
        return Meaning("geo_admin", "high")
    if has("lat", "latitud"):
        return Meaning("geo_lat", "medium", True)
    if has("lon", "lng", "longitud"):
        return Meaning("geo_lon", "medium", True)
    if has("nit"):
        return Meaning("identifier", "high")
    if numeric and any(f"_{n}".find(f"_{w}") >= 0 for w in MONEY):
        return Meaning("currency", "high")
    if numeric and ("porcentaje" in n or has("pct")):
        return Meaning("percentage", "medium")
    if has("anio", "ano", "mes", "trimestre", "semestre"):
        return Meaning("category", "high")
    named = bool(ID_LIKE.search(n))
    if named or (share(CODE.match) > 0.9 and uniqueness > 0.5):
        return Meaning("identifier", "high" if named and uniqueness > 0.9 else "medium")
    if 0 < distinct <= 3 and top and all(v.strip().lower() in BOOLEAN for v, _ in top):
        return Meaning("boolean_coded", "high")
    if numeric:
        return Meaning("category", "medium") if distinct <= 12 and rows > 50 else Meaning("integer" if integer else "number", "high")
    organisation = any(w in n for w in ORGANISATION_NAMES) or share(ORGANISATION.search) >= 0.2
    if has("nombre", "nombres") and not organisation and share(PERSON.match) > 0.7 and uniqueness > 0.3:
        return Meaning("person_name", "medium", True)
    ratio = distinct / rows if rows else 0.0
    if ratio < 0.1 and distinct <= 50:
        return Meaning("category", "medium")
    if avg_length > 40:
        return Meaning("free_text", "medium")
    return Meaning("free_text", "low") if ratio > 0.5 and avg_length > 15 else Meaning("unknown", "low")
