"""Ranks the accounts that spread low-veracity content in an interaction log."""

from spreadrank.params import DEFAULTS, Params, SkewLimits

__all__ = ["DEFAULTS", "Params", "SkewLimits"]
