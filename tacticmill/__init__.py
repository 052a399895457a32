"""Spark-first data engine for proof-trace corpora: scans, cleaning, joins,
retrieval, augmentation, reports and graph operators over DataFrames."""

__version__ = "0.1.0"
