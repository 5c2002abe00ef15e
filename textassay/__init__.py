"""textassay: text-corpus audits and paired evaluations as Spark jobs."""

__version__ = "0.1.0"
