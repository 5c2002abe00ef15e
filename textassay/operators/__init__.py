"""DataFrame operators: checks, counts, duplicates, samples, scores."""
