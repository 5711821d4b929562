"""Canonical JSON, digests, record keys and comparable fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(text: Column) -> Column:
    """NULL for anything that is not well-formed JSON with distinct keys."""
    return F.try_parse_json(text)


def canonical(value: Column) -> Column:
    """Compact JSON with sorted keys; the text two equal documents share."""
    return F.to_json(value)


def canonical_text(text: Column) -> Column:
    return canonical(variant(text))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def typed(value: Column, schema: str) -> Column:
    """The wanted fields as a struct: one pass instead of one lookup per field."""
    return F.from_json(canonical(value), schema)


def cast(value: Column, schema: str) -> Column:
    """The wanted fields as a struct, taken from the document without writing it out as text; for texts, structs and lists of them."""
    return F.try_variant_get(value, "$", f"struct<{schema}>")


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is costly to compute and computed exactly once per row.

    Catalyst pushes a filter through a projection by repeating the projected
    expression in it, so a parsed document would be parsed again for every field a
    filter looks at. It does not push one through the output of a generator.
    """
    return frame.select(*[c for c in frame.columns if c != name], F.explode(F.array(value)).alias(name))


# The JSON texts that count as "nothing there" for a required field.
FALSY = ("null", "false", "0", "0.0", '""', "[]", "{}")


def is_present(value: Column, name: str) -> Column:
    return F.coalesce(~canonical(part(value, name)).isin(*FALSY), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(canonical(value), F.lit("{")), F.lit(False))


def key_of(*parts: Column) -> Column:
    """A digest over a list that keeps NULL apart from ''."""
    return digest(F.to_json(F.array(*[p.cast("string") for p in parts])))


def _first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def record_key(kind: str, payload: Column) -> Column:
    """The identity under which rows of one kind are compared between snapshots."""
    get = lambda name: field(payload, name)
    if kind == "profiles":
        return key_of(get("record_id"))
    if kind == "observations":
        return key_of(get("record_id"), get("profile_url"), get("source_url"), get("collector"))
    if kind == "relationships":
        return key_of(
            _first_nonempty(get("subject_url"), get("subject_name")),
            get("relation"),
            _first_nonempty(get("object_url"), get("object_name")),
            get("source_url"),
            get("evidence_date"),
        )
    raise ValueError(f"Unknown kind {kind}")


def without_fields(payload: Column, *names: str) -> Column:
    """Canonical text of an object with some top-level fields gone.

    Each value keeps its own canonical JSON text, so nested documents survive.
    """
    entries = F.from_json(canonical(payload), "map<string,variant>")
    kept = F.map_filter(entries, lambda k, _: ~k.isin(*names))
    return F.to_json(F.map_from_entries(F.array_sort(
        F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"]).alias("value")))
    )))


def comparable(profile_id: Column, payload: Column) -> Column:
    """Fingerprint without acquisition time; the resolved profile takes part."""
    return key_of(profile_id, without_fields(payload, "observed_at"))
