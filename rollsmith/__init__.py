"""Rollout, dialogue and token analytics for language-model post-training, on Spark DataFrames."""
