"""Training-data operators: ten corpus operations built on Spark DataFrames and Arrow batches.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
