"""Progress, cancellation and incremental fact intake."""
