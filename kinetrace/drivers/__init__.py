"""Whole runs over the operators: session cache, training, prediction, with their sinks."""
