"""Reading, checking, keeping and writing tables."""
