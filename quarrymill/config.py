"""Settings of scoring and evaluation, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Weights of the four signals, thresholds of tiers and of the judge, the queue's budget, the day of reference, the seed."""

    keyword_weight: float = 0.20
    embedding_weight: float = 0.10
    parser_weight: float = 0.00
    llm_weight: float = 0.70
    high: float = 0.50
    medium: float = 0.30
    minimum: float = 0.10
    judge_confidence: int = 5
    budget: int = 20
    as_of: str = "2025-01-01"
    seed: int = 42

    def __post_init__(self) -> None:
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def weights(self) -> tuple[float, float, float, float]:
        return (self.keyword_weight, self.embedding_weight, self.parser_weight, self.llm_weight)

    def problems(self) -> list[str]:
        """What is wrong with the settings: weights add up to 1 within 0.02, thresholds fall, the judge's is 0 to 10."""
        out = []
        if not 0.98 <= sum(self.weights) <= 1.02:
            out.append(f"weights add up to {sum(self.weights):.3f}, not to 1")
        if min(self.weights) < 0:
            out.append("a weight is negative")
        if not self.high > self.medium > self.minimum:
            out.append("thresholds must fall: high, medium, minimum")
        if not 0 <= self.judge_confidence <= 10:
            out.append("judge_confidence is not from 0 to 10")
        return out
