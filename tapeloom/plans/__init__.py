"""Jobs of several steps: archives, merges, backfills, datasets, walk-forward evaluation."""
