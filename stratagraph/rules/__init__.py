"""The rule catalogue: importing the package registers every rule."""

from . import aws, azure, gcp, generic
from .registry import Registry, Rule, registry

__all__ = ["Registry", "Rule", "aws", "azure", "gcp", "generic", "registry"]
