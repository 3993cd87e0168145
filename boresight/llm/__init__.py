"""Training-data operators: dedup, decontamination, scans, mixing, formatting, quality."""
