"""Physical patterns that are written at DataFrame level."""
