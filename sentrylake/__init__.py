"""Network-telemetry analytics as Spark jobs: one flat event table, DataFrame operators on top."""

from sentrylake.profile import Profile, ProfileError
from sentrylake.schema import EVENT_SCHEMA, conform_events

__all__ = ["EVENT_SCHEMA", "Profile", "ProfileError", "conform_events"]
