"""Functions of the diff and replication engine."""
