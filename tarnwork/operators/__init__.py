from tarnwork.operators.exact_sum import exact_sum

__all__ = ["exact_sum"]
