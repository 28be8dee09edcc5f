"""Structured Streaming jobs."""

from hostpulse.streaming.fleet import Fleet, start_fleet, stream_new_events, sweep_once

__all__ = ["Fleet", "start_fleet", "stream_new_events", "sweep_once"]
