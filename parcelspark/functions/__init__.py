"""Column functions: text keys, dates, distances and scores."""
