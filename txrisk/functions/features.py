"""The 14 features of a request, in single precision, as Column expressions.

The production rules for absent objects hold: without a transaction all are zero; merchant features
need the customer too; only a missing last transaction gives -1.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.functions import parse
from txrisk.schema import DEFAULT_RISK, MCC_RISK, SCALE, Normalization


def f32(x: Column) -> Column:
    return x.cast("float")


def _float_literal(x: float) -> Column:
    return f32(F.lit(struct.unpack("<f", struct.pack("<f", x))[0]))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN stays."""
    zero, one = _float_literal(0.0), _float_literal(1.0)
    return F.when(F.isnan(x), x).when(x < 0, zero).when(x > 1, one).otherwise(x)


def clamped_once(x: Column) -> Column:
    """``clamp01`` of a costly value, which is evaluated once.

    Spark also plans a projection with a lambda as many short methods: all features in one are more than the
    JVM compiles, and it would interpret them for every row.
    """
    return F.transform(F.array(x), clamp01)[0]


def scaled(x: Column, most: float) -> Column:
    """Single-precision value times the single-precision reciprocal of its greatest value."""
    return clamp01(f32(f32(x) * _float_literal(1.0 / most)))


def round4(x: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(x, 4)


def mcc_risk(code: Column, table: dict[str, float] | None = None) -> Column:
    """Risk of a four-digit category code; the default for any other text."""
    table = MCC_RISK if table is None else table
    pairs = [F.lit(v) for kv in sorted(table.items()) for v in kv]
    known = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(DEFAULT_RISK))
    return F.coalesce(F.when(F.regexp_like(code, F.lit("^[0-9]{4}$")), F.try_element_at(known, code)), F.lit(DEFAULT_RISK))


def unknown_merchant(request: Column) -> Column:
    seen = F.coalesce(F.array_contains(request["customer"]["known_merchants"], request["merchant"]["id"]), F.lit(False))
    named = F.coalesce(F.length(request["merchant"]["id"]) > 0, F.lit(False))
    return F.when(named & ~seen, 1).otherwise(0)


def vector(request: Column, norm: Normalization, mcc: dict[str, float] | None = None) -> list[Column]:
    """The features of a request, v0 to v13."""
    tx, customer, merchant, terminal, last = (
        request[k] for k in ("transaction", "customer", "merchant", "terminal", "last_transaction")
    )
    amount, usual = parse.number(tx["amount"]), parse.number(customer["avg_amount"])
    ratio = F.when(usual > 0, amount / F.when(usual > 0, usual)).otherwise(0.0)
    at = parse.epoch_seconds(tx["requested_at"])
    minutes = f32(f32(at - parse.epoch_seconds(last["timestamp"])) / _float_literal(60.0))
    here, there = customer.isNotNull(), customer.isNotNull() & merchant.isNotNull()

    def given(test: Column, x: Column, absent: float = 0.0) -> Column:
        return F.when(test, f32(x)).otherwise(_float_literal(absent))

    raw = [
        scaled(amount, norm.max_amount),
        scaled(parse.number(tx["installments"]), norm.max_installments),
        given(here, scaled(ratio, norm.amount_vs_avg_ratio)),
        f32(f32(parse.hour(tx["requested_at"])) / _float_literal(23.0)),
        f32(f32(parse.weekday(tx["requested_at"])) / _float_literal(6.0)),
        given(last.isNotNull(), clamped_once(f32(minutes * _float_literal(1.0 / norm.max_minutes))), -1.0),
        given(last.isNotNull(), scaled(parse.number(last["km_from_current"]), norm.max_km), -1.0),
        given(terminal.isNotNull(), scaled(parse.number(terminal["km_from_home"]), norm.max_km)),
        given(here, scaled(parse.number(customer["tx_count_24h"]), norm.max_tx_count_24h)),
        f32(parse.flag(terminal["is_online"])),
        f32(parse.flag(terminal["card_present"])),
        given(there, unknown_merchant(request)),
        given(there, mcc_risk(merchant["mcc"], mcc)),
        given(there, scaled(parse.number(merchant["avg_amount"]), norm.max_merchant_avg_amount)),
    ]
    return [given(tx.isNotNull(), x).alias(f"v{d}") for d, x in enumerate(raw)]


def quantized(v: Column) -> Column:
    """Integer in -10000..10000: single-precision product, rounded half away from zero."""
    q = F.round(f32(v * _float_literal(float(SCALE))).cast("double")).cast("int")
    return F.greatest(F.lit(-SCALE), F.least(F.lit(SCALE), q))
