"""Content-defined chunking, deduplication, snapshots and verification over tables, on Spark."""
