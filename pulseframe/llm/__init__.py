"""Operations of a training-data pipeline: scans, filters, deduplication, mixing, tokens."""
