"""Flows composed of operators: cleaning, attention, panel, descriptive release."""
