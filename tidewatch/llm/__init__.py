"""Training-data operators: every module here is self-contained and nothing outside imports it."""
