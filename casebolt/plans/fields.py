"""Field catalog: names, types, aliases, virtual fields and what each may be used for."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # text, integer, real, date, boolean
    virtual: bool = False
    sortable: bool = True
    aggregatable: bool = True
    displayable: bool = True
    editable: bool = False
    source: str = "builtin"
    description: str = ""


# Other names of fields, and the fields a user may edit.
ALIASES = {"dataset": "dataset_name", "dataset_label": "dataset_name", "collected_from": "custodian", "created_date": "date_created", "modified_date": "date_modified"}
EDITABLE = {"author", "content_type", "date_created", "date_modified", "participants", "recipients", "subject", "title"}
VIRTUAL = {
    "dataset_name": Field("dataset_name", "text", True, False, True),
    "custodian": Field("custodian", "text", True, False, False),
    "participant": Field("participant", "text", True, False, False, False),
    "recipient": Field("recipient", "text", True, False, False, False),
    "production_name": Field("production_name", "text", True, False, False),
    "is_attachment": Field("is_attachment", "boolean", True, False, False),
    "has_attachments": Field("has_attachments", "boolean", True, False, False, False),
}
#: Virtual fields on the people of a document: name -> (role, what of the link). Names of several people have a plural form too.
PEOPLE = {"custodian": ("custodian", "label"), "participant": ("participant", "label"), "recipient": ("recipient", "label")}
for _role in ("author", "custodian", "participant", "recipient"):
    for _name in (_role, _role + "s") if _role in ("participant", "recipient") else (_role,):
        PEOPLE |= {f"raw_{_name}": (_role, "raw_value"), f"{_name}_entity_id": (_role, "entity_id")}
VIRTUAL |= {n: Field(n, "integer" if of == "entity_id" else "text", True, False, False, False) for n, (_, of) in PEOPLE.items() if n not in VIRTUAL}


class FieldError(ValueError):
    pass


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    return "real" if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) else "text"


#: Parts of declared column types that tell the kind, the first found deciding.
_DECLARED = {"date": "DATE|TIME", "integer": "INT", "real": "REAL|FLOA|DOUB"}


def declared_kind(declared: str) -> str:
    """Kind of a declared column type; text if nothing in it says otherwise."""
    return next((kind for kind, parts in _DECLARED.items() if re.search(parts, declared, re.I)), "text")


def sanitize(name: str) -> str:
    """A usable name of a custom field."""
    s = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", name.strip())).strip("_").lower()
    if not s:
        raise FieldError("empty field name")
    return f"field_{s}" if s[0].isdigit() else s


class Catalog:
    """Fields of a document DataFrame: its columns, virtual fields and custom fields."""

    def __init__(self, df: DataFrame, custom: tuple[str, ...] = (), hidden: tuple[str, ...] = ("text",)):
        self.fields = {f.name: Field(f.name, kind_of(f.dataType), editable=f.name in EDITABLE, source="custom" if f.name in custom else "builtin") for f in df.schema if f.name not in hidden}
        self.fields |= {k: v for k, v in VIRTUAL.items() if k not in self.fields}

    def resolve(self, name: str) -> Field:
        key = ALIASES.get(name.lower(), name.lower())
        for f in self.fields.values():
            if f.name.lower() == key:
                return f
        raise FieldError(f"unknown field: {name}")

    def add(self, name: str, kind: str, description: str = "") -> Field:
        clean = sanitize(name)
        if clean in self.fields or clean in ALIASES:
            raise FieldError(f"field exists: {clean}")
        if kind not in ("text", "integer", "real", "boolean", "date"):
            raise FieldError(f"unknown type: {kind}")
        self.fields[clean] = Field(clean, kind, editable=True, source="custom", description=description)
        return self.fields[clean]

    def describe(self, name: str, text: str) -> None:
        f = self.resolve(name)
        self.fields[f.name] = replace(f, description=text)

    def rename(self, old: str, new: str) -> Field:
        f = self._custom(old)
        g = self.add(new, f.kind, f.description)
        del self.fields[f.name]
        return g

    def delete(self, name: str) -> None:
        del self.fields[self._custom(name).name]

    def _custom(self, name: str) -> Field:
        f = self.resolve(name)
        if f.source != "custom":
            raise FieldError(f"not a custom field: {name}")
        return f

    def listing(self) -> list[dict]:
        """What may be searched, filtered, sorted and aggregated; date fields with their granularities."""
        return [
            {"name": f.name, "type": f.kind, "filter": True, "sort": f.sortable, "aggregate": f.aggregatable, "display": f.displayable, "edit": f.editable,
             "granularity": ["year", "quarter", "month", "week"] if f.kind == "date" else []}
            for f in self.fields.values()
        ]
