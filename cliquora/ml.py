"""The same operators as pyspark.ml transformers."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliquora.model import SimplicialComplex
from cliquora.operators import components, ensemble, vectors
from cliquora.operators.durable import durable, sized
from cliquora.sources import matrices

#: Vertices that a graph meets in one task.
BLOCK = 100_000


class _Named(Params):
    """Keyword arguments are params."""

    DEFAULTS: dict = {}

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        for name, default in self.DEFAULTS.items():
            setattr(self, name, Param(self, name, name))
            self._setDefault(**{name: default})
        unknown = set(self._input_kwargs) - set(self.DEFAULTS)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        self._set(**self._input_kwargs)

    def get(self, name: str):
        return self.getOrDefault(getattr(self, name))

    @property
    def params(self) -> list[Param]:
        return [getattr(self, n) for n in self.DEFAULTS]


class _Step(_Named, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer of params alone; it is saved as they are."""


class GradedParameters(_Step):
    """Graphs to vectors of equal length; flatten makes one array a graph.

    The dataset is either adjacency rows (complex_id, i, row ARRAY), whose every row is a vertex, or edges (complex_id, u, v). An
    edge table has no isolated vertices: n_vertices says that each graph has the vertices below it, or vertices is a DataFrame
    (complex_id, vertex). A row whose ends are null stands for a graph without edges.
    """

    DEFAULTS = {"metrics": None, "max_order": None, "fill_value": None, "flatten": False, "n_vertices": None, "vertices": None}

    def complexes(self, dataset: DataFrame) -> SimplicialComplex:
        if "row" in dataset.columns:
            return SimplicialComplex.from_adjacency(dataset)
        edges, sites, n = matrices.edges_of_pairs(dataset), self.get("vertices"), self.get("n_vertices")
        if n is not None:
            every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n > 0 else F.array().cast("array<bigint>")
            own = matrices.keyed(dataset).select("complex_id").distinct().select("complex_id", F.explode(every).alias("vertex"))
            sites = own if sites is None else sites.select("complex_id", "vertex").unionByName(own)
        return SimplicialComplex.from_graph(edges, sites)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = vectors.graded(self.complexes(dataset), self.get("metrics"))
        found = vectors.padded(found, self.get("max_order"), self.get("fill_value"))
        return vectors.flattened(found) if self.get("flatten") else found


class _ModelWriter(MLWriter):
    """Params as metadata, the learned vertices as Parquet beside them."""

    def __init__(self, model: GradedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.sites.write.parquet(f"{path}/sites")


class _ModelReader(MLReader):
    def load(self, path: str) -> GradedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GradedModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with(self.sparkSession.read.parquet(f"{path}/sites"))


class GradedModel(_Named, Model, MLReadable, MLWritable):
    """Graphs to vectors of the length and over the vertices that a fit has seen; order is the largest dimension there.

    sites: a DataFrame (vertex). A later graph has them all, isolated where it has no edge at them, and its own others. Levels above
    order are cut, and levels that a graph doesn't reach are filled.
    """

    DEFAULTS = {"metrics": None, "order": 0, "fill_value": None, "flatten": False}
    sites: DataFrame

    def _with(self, sites: DataFrame) -> GradedModel:
        self.sites = sites
        return self

    def copy(self, extra=None) -> GradedModel:
        return super().copy(extra)._with(self.sites)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset if "row" in dataset.columns else matrices.keyed(dataset)
        ids = matrices.keyed(rows).select("complex_id").distinct()
        step = GradedParameters(metrics=self.get("metrics"), max_order=self.get("order"), fill_value=self.get("fill_value"), flatten=self.get("flatten"))
        if "row" not in rows.columns:
            step._set(vertices=self._everywhere(ids))
        return step.transform(rows)

    def _everywhere(self, ids: DataFrame) -> DataFrame:
        """A row for each graph and learned vertex; vertices are dealt to blocks of about BLOCK, and every graph meets every block."""
        blocks = 1 + self.sites.count() // BLOCK
        dealt = self.sites.select("vertex", F.pmod(F.xxhash64("vertex"), F.lit(blocks)).alias("block"))
        return ids.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(sized(dealt), "block").drop("block")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class GradedEstimator(_Named, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns from an ensemble what GradedParameters is told: which vertices there are, and the largest order.

    The dataset is as there: edges (complex_id, u, v), or adjacency rows (complex_id, i, row), whose vertices are those of each graph.
    """

    DEFAULTS = {"metrics": None, "fill_value": None, "flatten": False}

    def _fit(self, dataset: DataFrame) -> GradedModel:
        k = GradedParameters().complexes(dataset)
        order = vectors.order(k).agg(F.max("value")).first()[0]  # one number
        own = {name: self.get(name) for name in self.DEFAULTS}
        model = GradedModel(order=max(0, 0 if order is None else order), **own)
        return self._copyValues(model)._with(durable(vectors.vertices(k).select("vertex").distinct()))


class SimplexProjection(_Step):
    """Simplices (complex_id, sid, members) to vertex pairs."""

    DEFAULTS = {"q": 0, "weighted": False}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return ensemble.projection(SimplicialComplex(dataset), self.get("q"), self.get("weighted"))


class GraphCliqueFilter(_Step):
    """Weighted edges to those in cliques of dimension q or more."""

    DEFAULTS = {"q": 0, "threshold": None}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return ensemble.clique_filter(dataset, self.get("q"), self.get("threshold"))


class QComponents(_Step):
    """Simplices to their component at one q."""

    DEFAULTS = {"q": 0}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        q = self.get("q")
        return components.q_components(SimplicialComplex(dataset)).where(f"q = {int(q)}").drop("q")


__all__ = ["GradedEstimator", "GradedModel", "GradedParameters", "GraphCliqueFilter", "Params", "QComponents", "SimplexProjection"]
