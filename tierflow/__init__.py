"""tierflow: declarative three-layer data pipelines on Spark DataFrames."""

from .plans import Pipeline, Run
from .spec import PipelineSpec, SpecError, load_pipeline, parse_pipeline

__all__ = [
    "Pipeline",
    "PipelineSpec",
    "Run",
    "SpecError",
    "load_pipeline",
    "parse_pipeline",
]
