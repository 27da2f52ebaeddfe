"""Parameters of the windowing, graph and split operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from flowloom import fixed


@dataclass(frozen=True)
class WindowConfig:
    """Half-open windows ``[t0, t0 + window_s)`` aligned to the epoch."""

    window_s: int = fixed.WINDOW_S
    stride_s: int | None = None
    min_flows: int = fixed.MIN_FLOWS
    min_nodes: int = fixed.MIN_NODES

    @property
    def stride(self) -> int:
        return self.window_s if self.stride_s is None else self.stride_s


@dataclass(frozen=True)
class GraphConfig:
    """Which hosts of a window become nodes, and how they are labelled."""

    min_flows_per_node: int = fixed.MIN_FLOWS_PER_NODE
    max_nodes: int = fixed.MAX_NODES
    label_rule: str = "any"  # "any" bot flow, or "majority" of flows


@dataclass(frozen=True)
class SequenceConfig:
    """How a host's flows inside one window become a capped sequence."""

    max_flows: int = fixed.MAX_FLOWS
    seed: int = fixed.SEED
    even: bool = False  # evenly spaced picks instead of a hash sample


@dataclass(frozen=True)
class SplitSpec:
    """Chronological fractions and the role of every scenario."""

    train_frac: float = fixed.TRAIN_FRAC
    val_frac: float = fixed.VAL_FRAC
    train_scenarios: tuple[str, ...] = ()
    holdout_test_scenarios: tuple[str, ...] = ()
    excluded: tuple[str, ...] = field(default_factory=tuple)
    version: int = 1
    seed: int = fixed.SEED

    @property
    def test_frac(self) -> float:
        return max(0.0, 1.0 - self.train_frac - self.val_frac)

    @property
    def scenarios(self) -> list[str]:
        """Every scenario that takes part in a split, training ones first."""
        return [*self.train_scenarios, *self.holdout_test_scenarios]

    @classmethod
    def from_dict(cls, cfg: dict) -> "SplitSpec":
        return cls(
            train_frac=float(cfg["train_frac"]),
            val_frac=float(cfg["val_frac"]),
            train_scenarios=tuple(cfg["train"]),
            holdout_test_scenarios=tuple(cfg.get("holdout_test") or ()),
            excluded=tuple(cfg.get("excluded") or ()),
            version=int(cfg["split_version"]),
            seed=int(cfg["seed"]),
        )

    @classmethod
    def load(cls, path: str) -> "SplitSpec":
        """Read the YAML (or JSON, a subset of it) form of a split."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ImportError:
            import json

            return cls.from_dict(json.loads(text))
        return cls.from_dict(yaml.safe_load(text))
