"""From assignment rows to readings: what is read unfiltered, what filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codeloom.config import AnalysisSettings
from codeloom.operators import growth as g
from codeloom.operators import occurrence as o


def analyse(responses: DataFrame, assignments: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> dict[str, DataFrame]:
    """Filter report, frequencies, patterns and growth over the unfiltered relation; the filtered relation for clustering."""
    if o.unknown_responses(responses, assignments).limit(1).count():
        raise ValueError("assignments name responses that the corpus lacks")
    occ = o.occurrence(assignments)
    batch_of = g.batches(responses, settings.saturation_batch)
    curve = g.growth(occ, batch_of)
    return {
        "filter": o.frequency_filter(occ, settings.min_code_frequency, settings.min_code_frequency_fraction),
        "frequencies": o.frequencies(occ),
        "signatures": o.signature_groups(occ),
        "pairs": o.frequent_pairs(occ, settings.min_support),
        "triples": o.frequent_triples(occ, settings.min_support, settings.max_triples),
        "families": o.cooccurrence(o.family_occurrence(occ)),
        "growth": curve,
        "saturated_at": g.saturated_at(curve),
        "spikes": g.spikes(curve),
        "filtered": o.filtered(occ, settings.min_code_frequency, settings.min_code_frequency_fraction),
    }
