"""Streams over the event log, the commits and the traces."""
