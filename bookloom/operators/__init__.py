"""Set-based operators over the catalogue, the log and reader state."""
