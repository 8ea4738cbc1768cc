"""Scalar functions on names, paths and JSON nodes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space.
BLANK = r"[ \t\x0B\r\n\f]+"


def compact(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def child(node: Column, key: str) -> Column:
    """The variant below a key; SQL NULL just where there is no such key."""
    return F.variant_get(node, f"$.{key}", "variant")


def is_string(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node) == "STRING", F.lit(False))


def is_object(node: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(node), F.lit("OBJECT")), F.lit(False))


def string_value(node: Column) -> Column:
    """A string node's text, else empty: numbers don't become text."""
    return F.when(is_string(node), F.try_variant_get(node, "$", "string")).otherwise(F.lit(""))


def string_field(node: Column, key: str) -> Column:
    return string_value(child(node, key))


def is_option(node: Column) -> Column:
    """An object with keys ``loc`` and ``type``, whatever they hold."""
    return child(node, "loc").isNotNull() & child(node, "type").isNotNull()


def option_summary(node: Column) -> Column:
    """The first usable of description, type and defaultText: a string (an empty one, too) or an object's text that isn't empty."""
    found = F.lit("")
    for key in ("defaultText", "type", "description"):
        value = child(node, key)
        text = F.when(is_object(value), string_field(value, "text")).otherwise(F.lit(""))
        found = F.when(is_string(value), compact(string_value(value))).when(text != "", compact(text)).otherwise(found)
    return found


def package_name(attr: Column, pname: Column, version: Column, output: Column) -> Column:
    """attr or pname, ``-version`` unless that stands in it, ``.output`` unless that's ``out``."""
    base = F.when(attr != "", attr).otherwise(pname)
    versioned = F.when((version == "") | F.contains(base, version), base).otherwise(F.concat(base, F.lit("-"), version))
    return F.when(output.isin("", "out"), versioned).otherwise(F.concat(versioned, F.lit("."), output))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def _before_dash(name: Column) -> Column:
    return F.when(F.instr(name, "-") > 1, F.substring_index(name, "-", 1)).otherwise(name)


def _after_dash(name: Column) -> Column:
    return F.when(F.instr(name, "-") > 1, F.substr(name, F.instr(name, "-") + 1)).otherwise(name)


def hash_from_path(path: Column) -> Column:
    """What stands before the first dash of the last part, if anything does; else that part."""
    return _before_dash(basename(path))


def split_name_version(name: Column) -> tuple[Column, Column]:
    """Name and version, cut at the last dash before a digit; without one, the whole and an empty text."""
    shape = r"(?s)^(.+)-([0-9].*)$"
    has = F.rlike(name, F.lit(shape))
    return F.when(has, F.regexp_extract(name, shape, 1)).otherwise(name), F.when(has, F.regexp_extract(name, shape, 2)).otherwise("")


def attr_label(attr: Column, output: Column) -> Column:
    return F.when(output == "out", attr).otherwise(F.concat(attr, F.lit("."), output))


def transitive_label(store_path: Column, ident: Column) -> Column:
    """The last part of a store path behind its first dash; without a path, the hash."""
    return F.when(F.coalesce(store_path, F.lit("")) == "", ident).otherwise(_after_dash(basename(store_path)))


def reference_hashes(references: Column) -> Column:
    """Hashes of references parted by white space."""
    tokens = F.filter(F.split(references, BLANK), lambda x: x != "")
    return F.transform(tokens, lambda x: _before_dash(F.substring_index(x, "/", -1)))


def child_path(path: Column, name: Column) -> Column:
    return F.concat(F.when(path == "/", "").otherwise(path), F.lit("/"), name)


def relative_path(root: Column, path: Column) -> Column:
    """The path below a root, from ``/`` on; the root itself is ``/``."""
    return F.when(path == root, "/").otherwise(F.concat(F.lit("/"), F.substr(path, F.length(root) + 2)))


def byte_trigrams(text: Column) -> Column:
    """Distinct runs of three bytes, as hexadecimal; none of less than three bytes."""
    raw = text.cast("binary")
    starts = F.when(F.octet_length(text) >= 3, F.sequence(F.lit(1), F.octet_length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.hex(F.substr(raw, i, F.lit(3)))))


def key_of_line(line: Column) -> Column:
    return F.substring_index(line, "\t", 1)


def key_bytes(line: Column) -> Column:
    """Distinct bytes of a line's key, as hexadecimal."""
    key = key_of_line(line)
    starts = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.hex(F.substr(key.cast("binary"), i, F.lit(1)))))


def kind_char(kind: Column, executable: Column) -> Column:
    return F.when(kind == "d", "d").when(kind == "s", "l").otherwise(F.when(executable, "x").otherwise(" "))


def parse_attrs(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def shared_prefix(a: str, b: str) -> int:
    """Bytes of the longest common start of two texts, whole characters only."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += len(x.encode())
    return n


def query_trigrams(query: str) -> list[str]:
    """Distinct runs of three bytes of a query, as ``byte_trigrams`` names them."""
    raw = query.encode()
    return sorted({raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)})
