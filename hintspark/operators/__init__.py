"""Table-wide operators: retrieval, splits, evidence, evaluation, training."""
