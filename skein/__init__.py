"""Code-knowledge-graph analytics on Spark."""

__version__ = "0.1.0"

from skein.build import build
from skein.engine import GraphEngine
from skein.operators.extract import build_graph
from skein.operators.graph import Graph
from skein.serve import Server, serve
from skein.sources.jsonl import read_graph, write_graph

__all__ = ["Graph", "GraphEngine", "Server", "build", "build_graph", "read_graph", "serve", "write_graph"]
