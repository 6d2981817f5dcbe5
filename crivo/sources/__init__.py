"""Scans, key lists, metadata, extractions and sinks."""

from . import keylist, metadata, scan, sink

__all__ = ["keylist", "metadata", "scan", "sink"]
