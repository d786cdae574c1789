"""Operators over traces: temporal operators, verdicts, resampling and buffer statistics."""
