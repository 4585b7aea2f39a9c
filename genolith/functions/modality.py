"""Modalities: the coordinate vocabularies of a dataset, found by name or as `module:Class`."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from genolith.functions import sequence as sq
from genolith.operators import mutations as mu


class Modality:
    """What a plug-in must provide."""

    name = ""

    def contexts(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def configurations(self) -> tuple[str, ...]:
        raise NotImplementedError

    def context_frequencies(self, sequences: DataFrame, key: str, seq: str) -> DataFrame:
        raise NotImplementedError

    def ingest(self, variants: DataFrame, chunks: DataFrame, blocks: DataFrame, **options) -> DataFrame:
        raise NotImplementedError

    def check(self, observations: DataFrame) -> None:
        """Raise unless the observations have the columns and codes of this modality."""
        need = {"configuration", "context", "locus", "weight"}
        if need - set(observations.columns):
            raise ValueError(f"observations lack {sorted(need - set(observations.columns))}")
        known = self.contexts(observations.sparkSession).select("label")
        if not observations.join(known, observations["context"] == known["label"], "left_anti").isEmpty():
            raise ValueError("observations have unknown contexts")


class SBS(Modality):
    name = "sbs"

    def contexts(self, spark):
        return sq.dim_context(spark)

    def configurations(self):
        return sq.CONFIGURATIONS

    def context_frequencies(self, sequences, key, seq):
        return sq.context_frequencies(sequences, key, seq)

    def ingest(self, variants, chunks, blocks, **options):
        return mu.ingest_observations(mu.ingest_rows(variants, chunks, blocks, **options))


BUILT_IN = {"sbs": SBS}


def modality(name: str) -> Modality:
    if name in BUILT_IN:
        return BUILT_IN[name]()
    module, _, cls = name.partition(":")
    if not cls:
        raise KeyError(f"no modality {name!r}; there are {sorted(BUILT_IN)}, or give module:Class")
    return getattr(importlib.import_module(module), cls)()
