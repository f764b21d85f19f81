"""tallyforge: a Spark-native engine for auditing business tables.

Every operator is a DataFrame transformation; the driver only ever holds
per-column metadata, aggregated rows and bounded samples.
"""

__version__ = "0.1.0"
