"""The registered queries: each with its Spark form and, where there is one, its SQL check."""
