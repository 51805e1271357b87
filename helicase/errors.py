"""What can be wrong with the input or the parameters."""


class DenoiseError(ValueError):
    """The base of all errors of this library."""


class InvalidBase(DenoiseError):
    """A letter other than A, C, G, T, U in either case."""


class SequenceTooShort(DenoiseError):
    """A read shorter than k."""


class InvalidK(DenoiseError):
    """k outside 1..15."""


class EmptyInput(DenoiseError):
    """No reads."""


class InvalidParam(DenoiseError):
    """A parameter outside its range, or an input in no known format."""
