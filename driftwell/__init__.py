"""Set reconciliation, difference estimation and deltas as DataFrame programs."""
