"""A Spark-native engine that turns text into a graph of facts and searches it."""

from .config import LoomConfig
from .operators.graph import FactGraph
from .plans.index import IndexPipeline
from .plans.retrieve import RetrievePipeline, SearchResult

__all__ = ["FactGraph", "IndexPipeline", "LoomConfig", "RetrievePipeline", "SearchResult"]
