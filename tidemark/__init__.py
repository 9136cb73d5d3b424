"""Time-series and relational analytics as DataFrame operators."""
