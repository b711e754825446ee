"""Writers: bronze days, load state, layers, marts, CSV pages and run metrics."""
