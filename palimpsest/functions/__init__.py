"""Part of the versioned key-value engine."""
