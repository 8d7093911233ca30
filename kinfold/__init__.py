"""Person-profile engine on Spark: untyped JSON messages in, one profile per person out."""

from kinfold.config import Config

__all__ = ["Config"]
