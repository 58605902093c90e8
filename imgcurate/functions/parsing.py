"""Reading JSON out of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket, null if there is no such stretch."""
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    there = (start > 0) & (F.instr(text, closing) > 0) & (end > start)
    return F.when(there, F.substring(text, start, end - start + 1))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing more, else null.

    ``try_parse_json`` stops after the first value whatever follows. So the text is
    parsed as a member of an object whose next member repeats a hash of it: the
    hash is only found again if the text was one whole value.
    """
    check = F.xxhash64(text)
    framed = F.try_parse_json(F.concat(F.lit('[{"value":'), text, F.lit(',"check":'), check.cast("string"), F.lit("}]")))
    members = F.try_variant_get(framed, "$[0]", "map<string,variant>")
    whole = (F.try_variant_get(framed, "$[0].check", "bigint") == check) & (F.size(members) == 2)
    return F.when(whole, F.try_variant_get(framed, "$[0].value", "variant"))


def parse_model_json(text: Column) -> Column:
    """M7: the JSON object in a text as VARIANT; null if none can be read or it is empty."""
    found = _between(text, "{", "}")
    mended = F.replace(F.replace(found, F.lit(",}"), F.lit("}")), F.lit(",]"), F.lit("]"))
    empty = mended.rlike(r"^\{[ \t\r\n]*\}$")
    return F.when(~empty, F.coalesce(strict_json(found), strict_json(mended)))


def parse_model_json_array(text: Column) -> Column:
    """M8: the JSON array in a text as VARIANT, without mending."""
    return strict_json(_between(text, "[", "]"))


def field_text(value: Column, field: str) -> Column:
    """A scalar field as text, null if it is missing."""
    return F.try_variant_get(value, f"$.{field}", "string")


def field_number(value: Column, field: str) -> Column:
    """A field as DOUBLE. Numbers in quotes count; anything else is missing."""
    return field_text(value, field).try_cast("double")


def field_flag(value: Column, field: str) -> Column:
    return field_text(value, field).try_cast("boolean")


def field_list(value: Column, field: str, element: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", f"array<{element}>")


def chat_content(response: Column) -> Column:
    """M6: ``choices[0].message.content`` of a chat response."""
    return F.get_json_object(response, "$.choices[0].message.content")
