"""Sources and sinks."""

from crateline.sources.tables import load

__all__ = ["load"]
