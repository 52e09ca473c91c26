"""Policies with the default values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TargetabilityPolicy:
    # fixed values
    min_length: int = 19
    max_length: int = 23
    seed: tuple[int, int] = (2, 8)
    central: tuple[int, int] = (9, 12)
    max_total: int = 2
    max_seed: int = 0
    max_central: int = 0
    max_nonseed: int = 2
    seed_only_max_total: int = 14
    seed_only_min_paired: int = 7


@dataclass(frozen=True)
class TranscriptPolicy:
    require_sequence_reference: bool = True
    allow_deprecated: bool = False
    allow_alternative_contigs: bool = False
    include_protein_coding: bool = True
    include_retained_intron: bool = True
    include_nonsense_mediated_decay: bool = True
    include_processed_transcript: bool = True
    include_pseudogene: bool = False
    include_readthrough: bool = False
    include_noncoding: bool = True
    support_levels: tuple[str, ...] | None = None


@dataclass(frozen=True)
class EffectPolicy:
    tolerance: float = 1e-9
    negligible: float = 0.10
    weak: float = 0.50
    moderate: float = 1.00
    moderate_support: int = 2
    strong_support: int = 4


@dataclass(frozen=True)
class ExpressionPolicy:
    direction_threshold: float = 0.25
    shrinkage: float = 0.35
    min_baseline: float = 10.0
    min_expressed: int = 2
    expressed_count: float = 1.0
    significance: float = 0.05
    biological_threshold: float | None = 0.5


@dataclass(frozen=True)
class InclusionPolicy:
    """Which sites make a transcript targetable; fixed values as defaults."""

    include_seed_only: bool = False
    include_ambiguous: bool = False
    include_exact: bool = True
    include_near: bool = True
    classes: tuple[str, ...] = ("exact_full_length_complement", "near_full_length_complement")
    require_cleavage: bool = True


@dataclass(frozen=True)
class IntendedTargetPolicy:
    """What a request for an intended target must bring and what happens where it doesn't; fixed values as defaults.

    gene_only: fail_stage, warning, preserve_uncertainty or accept_any_gene_transcript_site.
    on_failure: fail_stage, warning or preserve_invalid_with_status.
    """

    required: bool = True
    transcripts_required: bool = False
    gene_only: str = "preserve_uncertainty"
    on_failure: str = "fail_stage"
    classes: tuple[str, ...] = ("exact_full_length_complement", "near_full_length_complement")
    max_total: int = 2
    max_seed: int = 0
    max_central: int = 0
