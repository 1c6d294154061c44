"""Narrations and reasons as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean, last4


def narration(description: Column, credits: Column, head: Column, kind: Column, unit: Column, own_account: Column, party: Column, reference: Column, own_transfer: Column) -> Column:
    """own_transfer: whether the text names one of the own companies."""
    party, ref = F.coalesce(clean(party), F.lit("Party")), F.coalesce(clean(reference), F.lit("N/A"))
    tail, own = F.concat(F.lit("x"), last4(description)), F.coalesce(F.concat(F.lit("x"), F.right(clean(own_account), F.lit(4))), F.lit("our account"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    moved = F.when(credits > 0, F.concat(F.lit("Internal Fund Transfer (From "), tail, F.lit(" to "), own, F.lit(")"))).otherwise(F.concat(F.lit("Internal Fund Transfer (From "), own, F.lit(" to "), tail, F.lit(")")))
    internal = F.concat(F.when(own_transfer, moved).otherwise(F.lit("Internal Transfer")), F.lit(" | Ref: "), ref, F.lit(" | Type: "), text(kind), F.lit(" | BU: "), text(unit), F.lit(" | Head: Internal"))
    collected = F.concat(F.lit("Receipt Credit (Collection) | Ref: "), ref, F.lit(" | From: "), party, F.lit(" | BU: "), text(unit))
    received = F.concat(F.lit("Receipt Credit from "), tail, F.lit(" (Purpose: "), text(unit), F.lit(") | Ref: "), ref, F.lit(" | BU: "), text(unit), F.lit(" | Head: "), text(head))
    purpose = F.when(F.lower(text(head)).contains("salary"), F.lit("Salary")).otherwise(text(unit))
    paid = F.concat(F.lit("Payment Disbursement (Purpose: "), purpose, F.lit(") | To: "), party, F.lit(" | Ref: "), ref, F.lit(" | BU: "), text(unit), F.lit(" | Head: "), text(head))
    return F.when(head == "Internal", internal).when(credits > 0, F.when(kind == "Customer Collection", collected).otherwise(received)).otherwise(paid)


def reason(*parts: Column) -> Column:
    """The explanations that there are, between bars."""
    return F.concat_ws(" | ", *parts)


def explained(field: str, value: Column, by: Column) -> Column:
    """What a field was set to and by which rule; null where it was not resolved."""
    return F.when(value.isNotNull() & (value != "?") & (value != ""), F.concat(F.lit(f"{field}: "), value, F.lit(" ("), F.coalesce(by, F.lit("default")), F.lit(")")))
