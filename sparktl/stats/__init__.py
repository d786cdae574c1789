"""Noise on signals and statistical checks of formulas."""
