"""whyframe: SQL with why-provenance on Spark, plus corpus operators in ``whyframe.llm``."""

__version__ = "0.1.0"
