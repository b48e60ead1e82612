"""The packed format: tokens, batches, frames and byte transforms. Used inside workers, on one batch at a time."""
