"""Task code, views of upstream tasks, and running pipelines of them."""

from .namespace import current_schema, scoped_views
from .pipeline import Pipeline, Run
from .preview import preview, preview_rows, try_task
from .tasks import run_code

__all__ = [
    "Pipeline",
    "Run",
    "current_schema",
    "preview",
    "preview_rows",
    "run_code",
    "scoped_views",
    "try_task",
]
