"""Typed conditions. Each carries its evidence as data, so a caller need not read the text."""

from __future__ import annotations

import logging
import warnings

log = logging.getLogger("veraframe")


class Condition(Exception):
    """Root of all conditions of this library."""


class FrameError(Condition):
    """Root of the errors."""

    def __init__(self, message: str, **evidence):
        super().__init__(message)
        self.evidence = evidence
        for name, value in evidence.items():
            setattr(self, name, value)


class InputError(FrameError):
    """A bad argument."""


class TypeVocabularyError(FrameError):
    """A data type outside the vocabulary, or values that a type can't hold."""


class CodecError(FrameError):
    """A file that can't be read, or data that a format can't hold."""


class CodelistError(FrameError):
    """Values without a codelist entry."""


class ConformanceError(FrameError):
    """Findings of severity error; ``findings`` has all of them."""


class SpecError(FrameError):
    """A specification that contradicts itself."""


class ValidationError(FrameError):
    """Findings of spec rules; ``findings`` has all of them."""


class FrameWarning(Condition, UserWarning):
    """Root of the warnings."""


class CoercionWarning(FrameWarning):
    """Values became missing."""


class ConformanceWarning(FrameWarning):
    """Findings of severity error or warning."""


class CodelistWarning(FrameWarning):
    """Values matched only after trimming or ignoring case."""


class EncodingWarning(FrameWarning):
    """Characters were replaced, folded or dropped."""


class OrderWarning(FrameWarning):
    """Variables without an order trail."""


class SpecWarning(FrameWarning):
    """Repeated rows of a specification were resolved."""


class ValidationWarning(FrameWarning):
    """Findings of spec rules."""


class CodecWarning(FrameWarning):
    """A format keeps less than the data have."""


def warn(category: type[FrameWarning], message: str) -> None:
    warnings.warn(category(message), stacklevel=3)


def inform(kind: str, message: str) -> None:
    log.info("%s: %s", kind, message)
