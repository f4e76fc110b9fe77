"""Access masks and class-file versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: access bits of the class-file format, in listing order ----------------------
CLASS_FLAGS = {
    "public": 0x0001,
    "private": 0x0002,
    "protected": 0x0004,
    "final": 0x0010,
    "super": 0x0020,
    "interface": 0x0200,
    "abstract": 0x0400,
    "synthetic": 0x1000,
    "annotation": 0x2000,
    "enum": 0x4000,
    "record": 0x10000,
    "module": 0x8000,
}
METHOD_FLAGS = {
    "public": 0x0001,
    "private": 0x0002,
    "protected": 0x0004,
    "static": 0x0008,
    "final": 0x0010,
    "synchronized": 0x0020,
    "bridge": 0x0040,
    "varargs": 0x0080,
    "native": 0x0100,
    "abstract": 0x0400,
    "strict": 0x0800,
    "synthetic": 0x1000,
}
FIELD_FLAGS = {
    "public": 0x0001,
    "private": 0x0002,
    "protected": 0x0004,
    "static": 0x0008,
    "final": 0x0010,
    "volatile": 0x0040,
    "transient": 0x0080,
    "synthetic": 0x1000,
    "enum": 0x4000,
}
MODULE_FLAGS = {"open": 0x0020, "synthetic": 0x1000, "mandated": 0x8000}
REQUIRES_FLAGS = {"transitive": 0x0020, "static": 0x0040, "synthetic": 0x1000, "mandated": 0x8000}
EXPORTS_FLAGS = {"synthetic": 0x1000, "mandated": 0x8000}
VOCABULARIES = {
    "class": CLASS_FLAGS,
    "method": METHOD_FLAGS,
    "field": FIELD_FLAGS,
    "module": MODULE_FLAGS,
    "requires": REQUIRES_FLAGS,
    "exports": EXPORTS_FLAGS,
}


def bit(mask: Column, name: str, target: str) -> Column:
    """Is the named flag set?  A name the target does not know is false."""
    value = VOCABULARIES[target].get(name)
    if value is None:
        return F.lit(False)
    return mask.bitwiseAND(F.lit(value)) != 0


def flag_list(mask: Column, target: str) -> Column:
    """Names of all set flags, in listing order."""
    names = [F.when(bit(mask, name, target), F.lit(name)) for name in VOCABULARIES[target]]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def java_version(major: Column) -> Column:
    """Release of a class-file major version: 45 to 48 are 1.1 to 1.4, 49 to 69 are 5 to 25."""
    release = (
        F.when(major.between(45, 48), F.concat(F.lit("Java 1."), (major - 44).cast("string")))
        .when(major.between(49, 69), F.concat(F.lit("Java "), (major - 44).cast("string")))
    )
    return F.coalesce(release, F.concat(F.lit("Unknown ("), major.cast("string"), F.lit(")")))


def class_kind(access: Column) -> Column:
    """Kind of a class by priority; a null mask is a class outside the corpus."""
    out = F.when(access.isNull(), "EXTERNAL")
    for flag, kind in [
        ("annotation", "ANNOTATION"),
        ("interface", "INTERFACE"),
        ("enum", "ENUM"),
        ("record", "RECORD"),
        ("abstract", "ABSTRACT_CLASS"),
    ]:
        out = out.when(bit(access, flag, "class"), kind)
    return out.otherwise("CLASS")
