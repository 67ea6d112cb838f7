from tidepoint.functions import identity, numbers, text

__all__ = ["identity", "numbers", "text"]
