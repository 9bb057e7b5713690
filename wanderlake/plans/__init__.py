"""Physical choices: staging, strategy by size, walker batches, partition diagnostics."""
