"""DataFrame operators: mapping, validation, encoding, assembly, rollups and reconciliation."""
