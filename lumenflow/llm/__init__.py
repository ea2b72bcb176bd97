"""Training-data operators: each numbered operator is one module; ``registry`` names their queries."""
