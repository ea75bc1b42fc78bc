"""The one error class that this package promises for a caller's mistakes."""


class MarginError(ValueError):
    """A request that can't be planned; raised before any data are read, unless a data check was asked for."""
