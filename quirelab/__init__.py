"""quirelab: corpus statistics and corpus-scale data processing on Spark DataFrames."""

__version__ = "0.1.0"
