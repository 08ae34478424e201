"""Settings of a lineage run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

METHODS = ("mp", "nj", "ml")
#: Method names that users of comparable tools know.
ALIASES = {"raxmlMP": "mp", "rapidnjNJ": "nj", "fasttreeML": "ml", "raxmlML": "ml"}
MODELS = ("JC", "F81", "F81+G", "GTR", "GTR+G")
#: Other names for general time reversible rates with rate categories.
NEAREST = {"GTRCAT": "GTR+G", "GTRGAMMA": "GTR+G"}


@dataclass(frozen=True)
class LineageConfig:
    """Every option of a run; the command line sets the same names."""

    method: str = "mp"
    #: (names, aligned sequences) -> Newick; the name ``root`` is among them. Overrides ``method``.
    builder: Callable[[list[str], list[str]], str] | None = None
    subsample: int = 10
    tip_sample: int = 10**10
    threshold: int = 10
    placement: str = "ML"
    careful: int = 1
    max_rounds: int = 5
    unaligned: bool = False
    realign_ratio: float = 0.5
    edits: bool = False
    model: str = "GTRCAT"
    seed: int | str = 0
    max_clades: int = 10_000
    #: What becomes of a clade that no round could divide: "drop" or "polytomy".
    unresolved: str = "drop"
    #: Problematic rows of a clade that join its sample for the next round; all by default.
    retry_rows: int | None = None
    #: Rows of a clade beyond which it counts as large and is placed in parts.
    chunk: int = 10_000
    keep: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "method", ALIASES.get(self.method, self.method))
        if self.method not in METHODS:
            raise ValueError(f"method {self.method!r} is none of {METHODS} and {tuple(ALIASES)}")
        if self.placement not in ("ML", "MP"):
            raise ValueError("placement is ML or MP")
        if self.edits and self.placement != "MP":
            raise ValueError("edit lists are placed by MP")
        if self.edits and self.unaligned:
            raise ValueError("edit lists have no alignment")
        if self.unresolved not in ("drop", "polytomy"):
            raise ValueError("unresolved is drop or polytomy")
        if min(self.subsample, self.threshold, self.tip_sample) < 2:
            raise ValueError("subsample, threshold and tip_sample are 2 at least")
        if self.max_rounds < 2:
            raise ValueError("max_rounds is 2 at least: a run makes max_rounds - 1 rounds")
        if self.model not in (*MODELS, *NEAREST):
            raise ValueError(f"model is one of {MODELS} or {tuple(NEAREST)}")

    def substitution(self) -> str:
        """The model that is computed."""
        return NEAREST.get(self.model, self.model)

    def estimated(self) -> bool:
        """Whether exchange rates are estimated: where likelihoods are computed on aligned sequences."""
        return self.substitution().startswith("GTR") and not self.edits and not self.unaligned and (self.placement == "ML" or self.method == "ml")

    def seed_value(self) -> int:
        """The seed; ``random`` draws one for this run."""
        if self.seed == "random":
            import secrets

            return secrets.randbits(31)
        return int(self.seed)
