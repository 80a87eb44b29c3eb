"""Plan builders: dense places, split scans, plan checks."""
