"""Content-addressed identifiers, paths and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def payload(*fields: Column | str) -> Column:
    """The fields as a JSON array of strings and nulls, so that no two lists of fields have one payload."""
    return F.to_json(F.array(*[_column(f).cast("string") for f in fields]))


def stable_id(kind: str, *fields: Column | str) -> Column:
    """kind_ and the first 24 hex digits of the SHA-256 of the versioned kind and the fields' payload; null and empty differ."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(F.lit(f"{kind}/v1\n"), payload(*fields)), 256), 1, 24))


def ratio(owned: Column | str, total: Column | str) -> Column:
    """owned / total, and 1 where there is nothing to own."""
    owned, total = _column(owned), _column(total)
    return F.when(total == 0, F.lit(1.0)).otherwise(owned.cast("double") / F.greatest(total, F.lit(1)))


def parts_of(path: Column | str) -> Column:
    return F.split(_column(path), "/")


def name_of(path: Column | str) -> Column:
    return F.element_at(parts_of(path), -1)


def suffix_of(path: Column | str) -> Column:
    """The last dotted part of the file's name, lower case; none for dot files."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^./]+)$", 1))


def normal_path(path: Column | str) -> Column:
    """A relative POSIX path without empty and . parts; null for paths that hold NUL, are absolute or begin with .., and for empty ones."""
    path = _column(path)
    plain = F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")
    return F.when(~path.contains("\0") & ~path.startswith("/") & (plain != "") & (F.split(plain, "/")[0] != ".."), plain)
