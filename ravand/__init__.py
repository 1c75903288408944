"""ravand: a PySpark-native engine for speech-transcript and manifest data."""

__version__ = "0.1.0"
