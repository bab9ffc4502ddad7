"""Outputs: submission files, per-segment report tables and issue exports."""
