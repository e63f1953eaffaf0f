"""Table readers and writers, request envelopes, and the derived test tables."""
