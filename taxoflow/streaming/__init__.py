"""Extension beyond batch: windowed counts over streams."""

from taxoflow.streaming.windows import windowed_counts

__all__ = ["windowed_counts"]
