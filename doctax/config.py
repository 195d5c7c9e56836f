"""Options of a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RunConfig:
    """Knobs of a run; ``metadata`` is what is written beside its results."""

    chunk_tokens: int = 512
    context_words: int = 1024
    context_sentences: int = 2
    lexical_top: int = 100
    dense_top: int = 100
    top: int = 50
    rrf_floor: float = 0.015
    accept: int = 10
    judge: int = 10
    score_floor: float = 0.70
    threshold_high: float | None = None
    threshold_low: float = 0.15
    rescue_rank: int = 0
    use_cross_encoder: bool = True
    use_judge: bool = True
    use_grounding: bool = True
    grounding_passes: int = 3
    grounding_batch: int = 15
    expand_siblings: bool = True
    query_generation: bool = False
    causal_synthesis: bool = False
    max_evidence: int = 3
    max_context: int = 16384
    max_tokens: int = 8192

    def __post_init__(self):
        if self.grounding_passes < 1:
            raise ValueError("there must be a grounding pass")
        if self.threshold_high is not None and self.threshold_high < self.threshold_low:
            raise ValueError("the high threshold is below the low one")

    @property
    def needs_model(self) -> bool:
        """Whether an enabled stage calls a language model."""
        return self.use_judge or self.use_grounding or self.expand_siblings or self.query_generation or self.causal_synthesis

    def metadata(self) -> dict:
        return asdict(self) | {"needs_model": self.needs_model}
