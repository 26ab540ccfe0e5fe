"""benthos: preparation and scoring of multimodal instruction data as Spark plans."""

__version__ = "0.1.0"
