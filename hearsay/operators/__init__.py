"""Table-level operators: cleaning, deduplication, top-k, quality reports, marts, exploration."""
