"""Operators of a large-scale training-data pipeline (see README, section "Training-data operators").

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it."""
