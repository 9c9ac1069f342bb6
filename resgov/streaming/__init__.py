"""Structured Streaming over decision logs: stateless validation (T1) and a
``foreachBatch`` fold into a versioned registry state (T2)."""

from .decisions import (RegistryState, quarantine_stream, registry_sink, start_registry_stream,
                        validated_stream)

__all__ = ["RegistryState", "quarantine_stream", "registry_sink", "start_registry_stream", "validated_stream"]
