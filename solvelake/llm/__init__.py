"""Operations of a large training-data pipeline: deduplication, filtering, classification, decontamination, packing."""
