"""guardlens: guarded relational constraints over operational traces, as Spark jobs."""

__version__ = "0.1.0"
