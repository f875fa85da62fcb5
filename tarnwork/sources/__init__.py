from tarnwork.sources.tables import TABLES, day_start, load

__all__ = ["TABLES", "day_start", "load"]
