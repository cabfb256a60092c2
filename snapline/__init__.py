"""Play-by-play analytics, slate simulation and projection blending as PySpark jobs."""

__version__ = "0.1.0"
