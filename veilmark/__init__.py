"""Evaluation of text de-identification on Spark."""
