"""Several graphs under one folder, each a store of its own by name. No query spans two of them."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

from .catalog import check_identifier
from .errors import NotFoundError
from .operators import embed
from .service import GraphService
from .store import GraphStore


class GraphRegistry:
    def __init__(self, spark: SparkSession, root: str, default: str = "main", embedder: embed.Embedder | None = None, codec: str = "fp32"):
        self.spark, self.root, self.default = spark, root.rstrip("/"), check_identifier(default)
        self._options = {"embedder": embedder, "codec": codec}
        self._open: dict[str, GraphService] = {}
        self._lock = threading.Lock()

    def names(self) -> list[str]:
        """Graphs that have been written to."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        there = lambda path: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "catalog"))
        return sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory() and there(s.getPath()))

    def service(self, name: str | None = None, create: bool = True) -> GraphService:
        """The service of a graph, the same object each time. Without ``create`` it must have been written to."""
        name = check_identifier(name or self.default)
        with self._lock:
            if name not in self._open:
                if not create and name not in self.names():
                    raise NotFoundError(f"There is no graph {name}", f"Known: {', '.join(self.names()) or 'none'}")
                self._open[name] = GraphService(GraphStore(self.spark, f"{self.root}/{name}"), **self._options)
            return self._open[name]
