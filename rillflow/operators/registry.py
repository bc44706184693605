"""Registries of named functions: estimators, losses and reward managers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Function = Callable[..., Any]


class Registry:
    """Names are case-sensitive. With ``strict`` a name that is taken by another function is an error, else it is replaced."""

    def __init__(self, kind: str, strict: bool = True):
        self.kind, self.strict, self.known = kind, strict, {}

    def register(self, name: str) -> Callable[[Function], Function]:
        def add(f: Function) -> Function:
            if self.strict and self.known.get(name, f) is not f:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.known[name] = f
            return f

        return add

    def get(self, name: str) -> Function:
        if name not in self.known:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def dispatch(self, name: Column, *args: Column) -> Column:
        """What the function that each row's ``name`` stands for makes of ``args``; a name that isn't known, or null, is an error."""
        out = F.raise_error(F.concat(F.lit(f"unknown {self.kind} "), F.coalesce(name, F.lit("null"))))
        for known, f in reversed(self.known.items()):
            made = f(*args)
            out = F.when(name == known, made).otherwise(out)
        return out


ESTIMATORS = Registry("advantage estimator")
POLICY_LOSSES = Registry("policy loss", strict=False)
REWARD_MANAGERS = Registry("reward manager")
KL_CONTROLLERS = Registry("KL controller")
