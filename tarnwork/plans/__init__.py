from tarnwork.plans.pricing_summary import pricing_summary

__all__ = ["pricing_summary"]
