"""Schemas and constants of the scoring engine."""

from __future__ import annotations

from dataclasses import dataclass

DIMS = 14
SCALE = 10_000
K = 5

REQUEST = (
    "id string, transaction struct<amount:double,installments:bigint,requested_at:string>,"
    "customer struct<avg_amount:double,tx_count_24h:bigint,known_merchants:array<string>>,"
    "merchant struct<id:string,mcc:string,avg_amount:double>,"
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>,"
    "last_transaction struct<timestamp:string,km_from_current:double>"
)

FEATURES = (
    "amount", "installments", "amount_vs_avg", "hour", "weekday", "minutes_since_last", "km_from_last", "km_from_home",
    "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg",
)

# Risk by merchant category code, and the risk of any other code.
MCC_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Normalization:
    """Greatest values of the scaled features; all must be positive."""

    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0

    def __post_init__(self):
        bad = [k for k, v in vars(self).items() if not v > 0]
        if bad:
            raise ValueError(f"not positive: {', '.join(bad)}")


@dataclass(frozen=True)
class SearchConfig:
    """Knobs of the cluster-pruned search."""

    nprobe: int = 36
    quick: int = 16
    boundary_low: int = 2
    boundary_high: int = 3

    def clamped(self, nlist: int) -> SearchConfig:
        """Probe counts within 1..128 and the number of clusters; the quick tier within the probes."""
        nprobe = self.nprobe if self.nprobe >= 1 else 64
        nprobe = max(0, min(nprobe, nlist, 128))
        quick = self.quick if self.quick >= 1 else max(1, nprobe // 2)
        return SearchConfig(nprobe, min(quick, nprobe), self.boundary_low, self.boundary_high)
