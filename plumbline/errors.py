"""What goes wrong, by kind."""


class DataError(ValueError):
    """Input that an operator can't take."""


class MissingDataError(DataError, FileNotFoundError):
    """Files of an entity that aren't there."""


class FormatError(DataError):
    """A file format that isn't read."""


class ConfigError(DataError):
    """A role mapping or parameter that contradicts itself."""


class ExperimentError(DataError):
    """Assignments or outcomes that can't be analysed."""


class PowerError(DataError):
    """A power problem without a solution."""


class UpliftError(DataError):
    """Data or scores that uplift models can't use."""


class EconomicsError(DataError):
    """Scores or parameters that economics can't use."""


class WarehouseError(DataError):
    """Tables that can't be loaded."""
