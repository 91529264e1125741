"""URL, hash, duration and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_URL = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"
_ISO = r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
_HOURS = r"(?iuU)(\d+)\s*(?:giờ|gio|h)\b"
_MINUTES = r"(?iuU)(\d+)\s*(?:phút|phut|p)\b"


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no query, no fragment, no trailing slash but for the root."""
    u = F.btrim(url)
    scheme, host, path = (F.regexp_extract(u, _URL, k) for k in (1, 2, 3))
    short = F.regexp_replace(path, "/+$", "")
    canonical = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(short == "", F.lit("/")).otherwise(short))
    return F.when(u.rlike(_URL), canonical).otherwise(F.regexp_replace(u, "[?#].*$", ""))


def document_id(url: Column, prefix: str = "doc") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonicalize_url(url), 256), 1, 16))


def _json_string(value: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, _json_string), ", "), F.lit("]"))


def content_hash(title: Column, ingredients: Column, instructions: Column, compose: bool = True) -> Column:
    """sha256 of the normalised JSON array [title, ingredients, instructions]."""
    text = F.concat(F.lit("["), _json_string(title), F.lit(", "), _json_list(ingredients), F.lit(", "), _json_list(instructions), F.lit("]"))
    return F.sha2(T.normalize_text(text, compose=compose), 256)


def _number(text: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got == "", None).otherwise(got).try_cast("int")


def parse_duration_minutes(value: Column) -> Column:
    """Minutes of an ISO-8601 or spelled duration. Days and seconds are ignored; `1h30` has no unit for 30 and is null."""
    clean = T.clean_text(value)
    iso = F.coalesce(_number(clean, _ISO, 2), F.lit(0)) * 60 + F.coalesce(_number(clean, _ISO, 3), F.lit(0))
    spelled = F.coalesce(_number(clean, _HOURS, 1), F.lit(0)) * 60 + F.coalesce(_number(clean, _MINUTES, 1), F.lit(0))
    return F.when(clean == "", None).when(clean.rlike(_ISO), iso).when(clean.rlike(_HOURS) | clean.rlike(_MINUTES), spelled).when(clean.rlike(r"^\d+$"), clean.try_cast("int")).cast("int")


def total_time(prep: Column, cook: Column) -> Column:
    return F.when(prep.isNull() & cook.isNull(), None).otherwise(F.coalesce(prep, F.lit(0)) + F.coalesce(cook, F.lit(0))).cast("int")


def log_term_frequency(tf: Column) -> Column:
    return 1 + F.log(F.greatest(F.lit(1), tf).cast("double"))
