"""The reference time of the small tests."""

from datetime import datetime

NOW = datetime(2024, 5, 6, 13, 45, 30)
