"""Configuration (Z2): the settings the operators take, with validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from relevo.functions import fixed as X


@dataclass
class Config:
    source_table: str = "posts"
    min_upvote_threshold: int = X.MIN_UPVOTE_THRESHOLD
    utility_keywords: list[str] = field(default_factory=lambda: list(X.UTILITY_KEYWORDS))
    extra_feature_dim: int = X.EXTRA_FEATURE_DIM
    epochs: int = X.EPOCHS
    val_split: float = X.VAL_SPLIT
    model_path: str = "models"
    version: str = X.MODEL_VERSION
    k_recall: int = X.K_RECALL
    alpha: float = X.ALPHA
    top_k: int = X.TOP_K
    vector_dim: int = 64

    REQUIRED_SECTIONS = ("database", "training", "artifacts", "search_tuning")

    def validate(self) -> "Config":
        if not 0.0 <= float(self.alpha) <= 1.0:
            raise ValueError(f"alpha must lie in [0, 1], got {self.alpha}")
        if self.extra_feature_dim != 2:
            raise ValueError("extra_feature_dim must be 2 (expertise, utility)")
        if not 0.0 < self.val_split < 1.0:
            raise ValueError("val_split must lie in (0, 1)")
        if self.k_recall < 1 or self.top_k < 1:
            raise ValueError("k_recall and top_k must be positive")
        if not self.utility_keywords:
            raise ValueError("utility_keywords must not be empty")
        return self

    @classmethod
    def from_dict(cls, d: dict) -> "Config":
        missing = [s for s in cls.REQUIRED_SECTIONS if s not in d]
        if missing:
            raise KeyError(f"missing config sections: {missing}")
        db, tr, ar, st = (d[s] for s in cls.REQUIRED_SECTIONS)
        for key in ("project_id", "dataset"):
            if key not in db:
                raise KeyError(f"missing config key database.{key}")
        feats = d.get("features", {})
        return cls(
            source_table=db.get("source_table", "posts"),
            min_upvote_threshold=int(feats.get("min_upvote_threshold", X.MIN_UPVOTE_THRESHOLD)),
            utility_keywords=list(feats.get("utility_keywords", X.UTILITY_KEYWORDS)),
            extra_feature_dim=int(tr.get("extra_feature_dim", X.EXTRA_FEATURE_DIM)),
            epochs=int(tr.get("epochs", X.EPOCHS)),
            val_split=float(tr.get("val_split", X.VAL_SPLIT)),
            model_path=ar.get("model_path", "models"),
            version=str(ar.get("version", X.MODEL_VERSION)),
            k_recall=int(st.get("k_recall", X.K_RECALL)),
            alpha=float(st.get("alpha", X.ALPHA)),
        ).validate()

    @classmethod
    def from_yaml(cls, path: str) -> "Config":
        import yaml

        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f))
