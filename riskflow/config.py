"""Settings, one frozen dataclass for each layer."""

from __future__ import annotations

from dataclasses import dataclass, field

# What a risky purpose holds, on cleaned text, after its start or a space
RISK_STEMS = ("займ", "долг", "обнал", "налич", "перевод[a-zа-я0-9]* *карт", "вознагражд", "агентск", "дарен", "крипт", "btc( |$)", "usdt( |$)")
# The looser list for raw text, where there is no keyword flag
FALLBACK_STEMS = ("займ", "кредит", "возврат долга", "долг", "финансовая помощь", "консультац", "услуг", "агентск", "комиссион", "предоплат", "пожертв", "налич", "обнал")
# Loans and debts in a party's profile
LOAN_STEMS = ("займ", "долг", "кредит")
# Taxes and other payments to the state, which are green without other signs
TAX_STEMS = ("налог", "взнос", "госпошлин", "государственная пошлина", "пошлина в бюджет", "кбк", "октмо", "ифнс")
# English lists for the synthetic ledger
RISK_STEMS_EN = ("loan", "debt", "cash", "gift", "crypto", "promo", "small")
LOAN_STEMS_EN = ("loan", "debt", "credit", "economy")


@dataclass(frozen=True)
class Features:
    windows: tuple[int, ...] = (7, 14, 30, 90)
    novelty_rows: int = 30
    first_gap: int = 9999
    stems: tuple[str, ...] = RISK_STEMS


@dataclass(frozen=True)
class Fusion:
    min_party_rows: int = 10
    gamma: float = 0.5
    min_base_weight: float = 0.60
    graph_weight: float = 0.25
    history_cap: float = 0.15
    history_hyper: float = 200.0
    yellow: float = 0.31
    red: float = 0.70


@dataclass(frozen=True)
class Forest:
    trees: int = 300
    sample: int = 256
    seed: int = 42
    min_rows: int = 10
    group_rows: int = 100_000


@dataclass(frozen=True)
class Review:
    min_amount: float = 50_000.0
    sample_n: int = 20
    batch_size: int = 10
    attempts: int = 3
    pause: tuple[float, float] = (0.8, 2.0)  # seconds between tries, at random
    seed: int = 42


@dataclass(frozen=True)
class KnowledgeBase:
    history_hyper: float = 50.0
    suspicious_risk: float = 0.60
    review_ratio: float = 0.4
    recent: int = 20


@dataclass(frozen=True)
class Settings:
    features: Features = field(default_factory=Features)
    fusion: Fusion = field(default_factory=Fusion)
    forest: Forest = field(default_factory=Forest)
    review: Review = field(default_factory=Review)
    kb: KnowledgeBase = field(default_factory=KnowledgeBase)
    canonical: bool = True  # features under the names that the models ask for; False: absent names are 0
