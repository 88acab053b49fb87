"""User steps and custom pipeline stages.

The stages wrap this package's operators as ``pyspark.ml`` Transformers, so
they chain in a ``Pipeline`` and save/load with the standard persistence.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


def apply_step(fn, **frames):
    """Run a user step: a Python callable over named DataFrames (df, df1,
    df2, df3, data ...) that returns a DataFrame or a dict of them."""
    out = fn(**frames)
    if isinstance(out, DataFrame):
        return out
    if isinstance(out, dict):
        return out
    raise TypeError("a step returns a DataFrame or a dict of DataFrames")


class NormalizingTokenizer(Transformer, HasInputCol, HasOutputCol,
                           DefaultParamsReadable, DefaultParamsWritable):
    """T3 as a stage: lower, delete punctuation, split words, optional Porter stem."""

    stem = Param(Params._dummy(), "stem", "Porter-stem the tokens", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, stem=False):
        super().__init__()
        self._setDefault(stem=False)
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, inputCol=None, outputCol=None, stem=False):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset):
        from textflow.operators.text import normalize_tokens
        return normalize_tokens(dataset, self.getInputCol(), self.getOutputCol(),
                                stem=self.getOrDefault(self.stem))


class NarrativeSection(Transformer, HasInputCol, HasOutputCol,
                       DefaultParamsReadable, DefaultParamsWritable):
    """T12 as a stage."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, inputCol=None, outputCol=None):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset):
        from textflow.functions.incident import narrative_section
        return dataset.withColumn(self.getOutputCol(), narrative_section(self.getInputCol()))


class IncidentFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """X11 as a stage (fill, extract, fingerprint)."""

    fixNoon = Param(Params._dummy(), "fixNoon", "12 PM -> 12, 12 AM -> 0", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, fixNoon=False):
        super().__init__()
        self._setDefault(fixNoon=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        from textflow.plans.incidents import incident_features
        return incident_features(dataset, fix_noon=self.getOrDefault(self.fixNoon))
