"""Masks for personal data as native column expressions.

All of them keep null as null, and treat the value as its string form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "****"


def _text(c: Column) -> Column:
    return strip_space(c.cast("string"))


def strip_space(c: Column) -> Column:
    """Remove all surrounding white space; SQL ``trim`` removes the space character only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _keep_null(c: Column, masked: Column) -> Column:
    return F.when(c.isNotNull(), masked)


def _last_four(c: Column) -> Column:
    s = _text(c)
    shown = F.concat(F.lit(HIDDEN), F.right(s, F.lit(4)))
    return _keep_null(c, F.when(F.char_length(s) >= 4, shown).otherwise(HIDDEN))


def _email(c: Column, local_mask: Callable[[Column], Column]) -> Column:
    s = c.cast("string")
    local = F.split_part(s, F.lit("@"), F.lit(1))
    domain = F.split_part(s, F.lit("@"), F.lit(2))
    masked = F.concat(local_mask(local), F.lit("@"), domain)
    return _keep_null(c, F.when(F.contains(s, F.lit("@")), masked).otherwise(HIDDEN))


def mask_email(c: Column) -> Column:
    """Strict form: a local part of one character or none disappears, a short one shows its length class."""
    return _email(
        c,
        lambda local: F.when(F.char_length(local) <= 1, F.lit(HIDDEN))
        .when(F.char_length(local) <= 4, F.concat(F.left(local, F.lit(1)), F.lit("***")))
        .otherwise(F.concat(F.left(local, F.lit(1)), F.lit(HIDDEN))),
    )


def mask_email_preset(c: Column) -> Column:
    """Preset form: first character of the local part, then the hidden mark."""
    return _email(c, lambda local: F.concat(F.left(local, F.lit(1)), F.lit(HIDDEN)))


def mask_phone(c: Column) -> Column:
    return _last_four(c)


def mask_bank_account(c: Column) -> Column:
    return _last_four(c)


def mask_address(c: Column) -> Column:
    return _last_four(c)


def mask_id_card(c: Column) -> Column:
    s = _text(c)
    shown = F.concat(F.left(s, F.lit(3)), F.lit("********"), F.right(s, F.lit(4)))
    return _keep_null(c, F.when(F.char_length(s) >= 10, shown).otherwise(HIDDEN))


def mask_name(c: Column) -> Column:
    s = _text(c)
    return _keep_null(
        c,
        F.when(F.char_length(s) >= 2, F.concat(F.left(s, F.lit(1)), F.lit("**")))
        .when(F.char_length(s) == 1, F.concat(s, F.lit("*")))
        .otherwise(HIDDEN),
    )


def mask_credit_card(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    shown = F.concat(F.left(digits, F.lit(6)), F.lit(HIDDEN), F.right(digits, F.lit(4)))
    return _keep_null(c, F.when(F.char_length(digits) >= 10, shown).otherwise(HIDDEN))


#: Masks by the kind named in a preset rule.
PRESET_MASKS: dict[str, Callable[[Column], Column]] = {
    "email": mask_email_preset,
    "phone": mask_phone,
    "id_card": mask_id_card,
    "bank_account": mask_bank_account,
    "address": mask_address,
    "name": mask_name,
}
