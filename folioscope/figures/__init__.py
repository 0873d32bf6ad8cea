"""Figures: declarative specs of collected tables, drawn as SVG without other libraries."""
