from tarnwork.functions.money import charged, discounted, hundredths

__all__ = ["charged", "discounted", "hundredths"]
