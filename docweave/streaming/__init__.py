"""Structured Streaming helpers: the same operators over unbounded inputs."""

from docweave.streaming.runner import (fan_out_stream, new_items_stream, run_stream,
                                       stream_table)

__all__ = ["fan_out_stream", "new_items_stream", "run_stream", "stream_table"]
