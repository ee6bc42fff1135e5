"""Every threshold as a named field; one frozen value travels to the executors in closures."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CodingRules:
    min_codes_per_response: int = 2
    max_codes_per_response: int = 12
    max_codes_per_segment: int = 2
    segment_overlap: float = 0.5
    max_quote_sentences: int = 2
    max_quote_words: int = 40
    fuzzy_threshold: float = 0.85
    tau_high: float = 0.80
    tau_low: float = 0.45
    tau_fit: float = 0.30
    hierarchy_depth: int = 2
    require_description: bool = True
    check_name_grammar: bool = True


@dataclass(frozen=True)
class CheckpointPolicy:
    mode: str = "event_driven"
    hard_floor_responses: int = 50
    fixed_cadence: tuple[int, ...] = (10, 20, 30, 40, 50)
    max_near_duplicate_pairs: int = 3
    max_new_codes_per_batch: int = 8
    min_responses_between_checkpoints: int = 10
    spike_factor: float = 2.0
    spike_window: int = 3
    spike_min_new_codes: int = 4


@dataclass(frozen=True)
class AnalysisSettings:
    min_code_frequency: int = 2
    min_code_frequency_fraction: float | None = None
    n_clusters: int | None = None
    highlight: float = 0.4
    saturation_batch: int = 10
    min_support: int = 2
    nearest_mates: int = 5
    max_triples: int = 20_000
    affinity_alpha: float = 0.7
    affinity_threshold: float = 0.5


@dataclass(frozen=True)
class LexicalSettings:
    top_words: int = 20
    bootstraps: int = 50
    folds: int = 5
    min_df: int = 2
    min_per_class: int = 10


@dataclass(frozen=True)
class RunSettings:
    batch_size: int = 10
    retrieval_top_k: int = 8
    seed: int = 1729
    rules: CodingRules = field(default_factory=CodingRules)
    checkpoints: CheckpointPolicy = field(default_factory=CheckpointPolicy)
    analysis: AnalysisSettings = field(default_factory=AnalysisSettings)
    lexical: LexicalSettings = field(default_factory=LexicalSettings)
