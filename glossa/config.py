"""Run-time settings (plain dataclass, validated on construction)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    random_seed: int = 42
    test_size: float = 0.20
    val_size: float = 0.15
    threshold: float = 0.5
    model_version: str = "v0.1.0"
    text_column: str = "text"
    label_column: str = "label"
    # TF-IDF / LR defaults
    max_features: int | None = 50_000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2
    C: float = 1.0
    max_iter: int = 1_000
    # explanation defaults
    explain_samples: int = 200
    explain_features: int = 10

    def __post_init__(self) -> None:
        for name in ("test_size", "val_size"):
            v = getattr(self, name)
            if not 0.05 <= v <= 0.40:
                raise ValueError(f"{name} must be in [0.05, 0.40]; got {v}")
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError(f"threshold must be in [0, 1]; got {self.threshold}")
        lo, hi = self.ngram_range
        if lo < 1 or hi < lo:
            raise ValueError(f"bad ngram_range {self.ngram_range}")
        if self.min_df < 1:
            raise ValueError("min_df must be >= 1")
        if self.max_features is not None and self.max_features < 1:
            raise ValueError("max_features must be positive or None")
        for name, least in (("max_iter", 1), ("explain_samples", 2), ("explain_features", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.C <= 0:
            raise ValueError("C must be positive")


settings = Settings()
