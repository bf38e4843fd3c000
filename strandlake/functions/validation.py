"""Delta validation: exceptions for single images, error columns for whole logs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DeltaError(ValueError):
    """A delta isn't valid; `field` says where."""

    def __init__(self, message: str, field: str):
        super().__init__(message)
        self.field = field


class FormatError(DeltaError):
    pass


class MissingFieldError(DeltaError):
    pass


class PointerError(DeltaError):
    pass


def _is_text(value: Any) -> bool:
    return isinstance(value, str) and value != ""


def _is_scalar(value: Any) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def validate_image(image: Any) -> None:
    """Raises the first fault of a wire image: missing fields come before wrong ones."""
    if not isinstance(image, dict):
        raise FormatError("a delta is an object", "delta")
    for field in ("id", "timeCreated", "host", "creator", "pointers"):
        if field not in image:
            raise MissingFieldError(f"{field} is missing", field)
    for field in ("id", "host", "creator"):
        if not _is_text(image[field]):
            raise FormatError(f"{field} must be a non-empty string", field)
    when = image["timeCreated"]
    if isinstance(when, bool) or not isinstance(when, (int, float)) or not when > 0:
        raise FormatError("timeCreated must be a number above 0", "timeCreated")
    if isinstance(image["pointers"], dict):
        _validate_map(image["pointers"])
    elif isinstance(image["pointers"], list):
        _validate_list(image["pointers"])
    else:
        raise FormatError("pointers must be a list or an object", "pointers")


def _validate_list(pointers: list) -> None:
    if not pointers:
        raise FormatError("there must be a pointer", "pointers")
    for i, p in enumerate(pointers):
        at = f"pointers[{i}]"
        if not isinstance(p, dict):
            raise PointerError("a pointer is an object", at)
        if not _is_text(p.get("localContext")):
            raise PointerError("localContext must be a non-empty string", f"{at}.localContext")
        if "target" not in p or not _is_scalar(p["target"]):
            raise PointerError("target must be a scalar", f"{at}.target")
        if p.get("targetContext") is not None:
            if not _is_text(p["targetContext"]):
                raise PointerError("targetContext must be a non-empty string", f"{at}.targetContext")
            if not isinstance(p["target"], str):
                raise PointerError("with a targetContext the target must be a string", f"{at}.target")


def _validate_map(pointers: dict) -> None:
    if not pointers:
        raise FormatError("there must be a pointer", "pointers")
    for label, target in pointers.items():
        if not _is_text(label):
            raise PointerError("a label must be a non-empty string", "pointers")
        if isinstance(target, dict):
            if len(target) != 1 or not all(_is_text(x) for pair in target.items() for x in pair):
                raise PointerError("a reference has one non-empty entity and property", f"pointers.{label}")
        elif not _is_scalar(target):
            raise PointerError("a target must be a scalar or a reference", f"pointers.{label}")


def error_code() -> Column:
    """Of a row of the log: the first fault's code, or null. Missing fields come before wrong ones."""
    text_fields = ("delta_id", "host", "creator")
    code = F.lit(None).cast("string")
    wrong_target = F.exists("pointers", lambda p: p["target"].isNull() | p["target"]["kind"].isNull())
    bare_label = F.exists("pointers", lambda p: F.coalesce(p["local_context"], F.lit("")) == "")
    empty_context = F.exists("pointers", lambda p: F.coalesce(p["target_context"] == "", F.lit(False)))
    no_entity = F.exists("pointers", lambda p: p["target_context"].isNotNull() & (p["target"]["kind"] != "string"))
    checks = [(F.col(c).isNull(), f"missing:{c}") for c in ("delta_id", "time_created", "host", "creator", "pointers")]
    checks += [(F.col(c) == "", f"format:{c}") for c in text_fields]
    checks += [(F.col("time_created") <= 0, "format:time_created"), (F.size("pointers") == 0, "format:pointers")]
    checks += [(bare_label, "pointer:local_context"), (wrong_target, "pointer:target"), (empty_context, "pointer:target_context"), (no_entity, "pointer:target_kind")]
    for test, name in reversed(checks):
        code = F.when(test, name).otherwise(code)
    return code


def split_valid(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their `error_code`."""
    checked = log.withColumn("error_code", error_code())
    return checked.where("error_code IS NULL").drop("error_code"), checked.where("error_code IS NOT NULL")
