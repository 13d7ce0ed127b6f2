class DataError(ValueError):
    """The data or what was asked of it is unusable; the command line ends with code 2."""
