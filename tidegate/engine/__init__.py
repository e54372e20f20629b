"""Executing pipelines."""

from tidegate.engine.api import Engine
from tidegate.engine.config import EngineConfig

__all__ = ["Engine", "EngineConfig"]
