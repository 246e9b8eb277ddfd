"""glossa: labelled-text analytics on Spark DataFrames.

Corpus preparation, text cleaning, corpus statistics, TF-IDF features,
class-balanced logistic regression, scoring, sliced evaluation, error
analysis, explanation and streaming scoring — each expressed as ordinary
DataFrame / Spark ML / Structured Streaming jobs.
"""

__version__ = "0.1.0"
