"""Fixed schemas, labels and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

MONEY = "decimal(18,5)"
_PLAY = f"Odds double, Wagers {MONEY}, Winnings {MONEY}"
_PAY = f"Date date, Time string, PayMeth string, PayMethCat string, Amount {MONEY}, Status string"

# The eight source tables.
SOURCES = {
    "country_reference": "CountryCode int, Country string",
    "demographics": "UserID bigint, DateOfBirth date, Gender string, CountryCode int",
    "games": f"UserID bigint, Date date, CashGames int, {_PLAY}",
    "tournaments": f"UserID bigint, Date date, Tournaments int, {_PLAY}",
    "deposits_successful": f"UserID bigint, DepositID bigint, {_PAY}",
    "deposits_failed": f"UserID bigint, DepositID bigint, {_PAY}",
    "withdrawals_successful": f"UserID bigint, WithdrawalID bigint, {_PAY}",
    "withdrawals_failed": f"UserID bigint, WithdrawalID bigint, {_PAY}",
}

# Column order of the player-day table.
PLAYER_DAY = [
    "UserID", "ActivityDate", "Gender", "Age", "Country", "CountryCode",
    "CashGames", "CashGameWagers", "CashGameWinnings", "CashGameAvgOdds",
    "Tournaments", "TournamentWagers", "TournamentWinnings", "TournamentAvgOdds",
    "DepositAmount", "DepositFailedAmount", "DepositSuccessCount", "DepositFailedCount",
    "WithdrawalAmount", "WithdrawalFailedAmount", "WithdrawalSuccessCount", "WithdrawalFailedCount",
]
NUMERIC = [c for c in PLAYER_DAY if c not in ("UserID", "ActivityDate", "Gender", "Country", "CashGameAvgOdds", "TournamentAvgOdds")]

# Column order of the delivered player segments.
PLAYER_SEGMENTS = [
    "UserID", "Gender", "Age", "AgeBand", "AgeEligibilityFlag", "Country", "CountryCode",
    "FirstActivityDate", "LastActivityDate", "TenureDays", "RecencyDays", "Frequency", "ActivityRate", "MaxConsecutiveActiveDays",
    "CashGames", "CashGameWagers", "CashGameWinnings", "AvgCashOdds", "Tournaments", "TournamentWagers", "TournamentWinnings",
    "WagerAmount", "WinningAmount", "CashGameShare", "TournamentShare", "WagerPerActiveDay", "NetGaming", "NetLossPerActiveDay",
    "DepositAmount", "WithdrawalAmount", "WithdrawalToDeposit", "Playthrough", "DepositFailedCount", "WithdrawalFailedCount", "FailedTxnRate",
    "LossChasingDays", "DepositEscalationRatio", "RecentDepositWithoutEarlierBaseline",
    "RecencyScore", "FrequencyScore", "MonetaryScore", "RFMScore", "KMeansCluster", "Behaviour Archetype", "Value Segment", "Value Segment (RFM Score)",
    "AML_PassThrough", "AML_WithdrawalNoDeposit", "AML_WithdrawalExceedsDeposit", "AML_CardTesting", "AML_LargeWithdrawalVolume", "AMLRiskScore",
    "RG_LossChasing", "RG_DepositEscalation", "RG_HighLossVelocity", "RG_SustainedIntensity", "RG_HighAbsoluteLoss", "RGRiskScore",
    "Risk Driver", "Risk Segment",
]

# Ordered labels, lowest first.
VALUE_LABELS = ["Low Value", "Medium Value", "High Value", "Premium"]
RISK_LABELS = ["Low Risk", "Medium Risk", "High Risk"]

# The review table.
REVIEW = ["Activity Date", "Player ID", "Gender", "Age", "Country", "Wager Amount", "Winning Amount", "Deposit Amount", "Withdrawal Amount", "Review Status", "Decision", "Comment"]
REVIEW_STATUSES = ["To be reviewed", "Review in Progress", "Review Completed"]
REVIEW_DECISIONS = ["No Action required", "Operator Review needed", "Account Freeze requested"]


# Default thresholds and settings of both classes below.
@dataclass(frozen=True)
class RiskThresholds:
    """Cut-offs of the review rules."""

    passthrough_deposit: float = 5000.0
    passthrough_playthrough: float = 0.10
    passthrough_ratio: float = 0.80
    ratio_deposit: float = 2000.0
    ratio: float = 1.50
    card_fails: int = 10
    card_rate: float = 0.50
    withdrawal_quantile: float = 0.99
    chasing_days: int = 10
    escalation_ratio: float = 2.00
    escalation_tenure: int = 180
    velocity_quantile: float = 0.95
    loss_quantile: float = 0.95
    streak_days: int = 30
    high_aml: int = 3
    high_rg: int = 4
    medium_aml: int = 1
    medium_rg: int = 2


@dataclass(frozen=True)
class KMeansConfig:
    """Settings of the value clustering."""

    k: int = 4
    seed: int = 42
    n_init: int = 20
    max_iter: int = 100
    tol: float = 1e-6
    k_range: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    silhouette_sample: int = 1500


MIN_LEGAL_AGE = 19
