"""The operators chained into one run, from raw files to rules."""
