"""The library's own steps as Spark ML stages, so that a whole workflow -- raw
listing in, prediction out -- is one ``PipelineModel`` that can be saved,
loaded in another session and applied to a batch or a stream.

* ``FrequencyIndexer`` / ``FrequencyIndexerModel`` -- the distributed category
  index of ``features.fit_index``; the model's labels are saved as Parquet.
* ``TypedListings`` -- workflow A's typed columns from raw listings.
* ``ClusterColumns`` -- workflow B's numbers and category texts.
* ``Doubles`` -- feature columns as doubles, nulls as zeros if wanted.

Every transformer works row by row (or joins fitted tables), keeps the input's
other columns, and is allowed on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.flags import ELEVATOR_YES, NEW_CONSTRUCTION_YES, equals_flag
from hearth.functions.parse import ceiling_height, parse_int, price_usd
from hearth.operators import clean, features


class _IndexParams(HasInputCols, HasOutputCols, HasHandleInvalid):
    def _names(self) -> dict[str, str]:
        ins = self.getInputCols()
        outs = self.getOutputCols() if self.isSet(self.outputCols) else [f"{c}_index" for c in ins]
        if len(ins) != len(outs):
            raise ValueError(f"{len(ins)} input columns, {len(outs)} output columns")
        return dict(zip(ins, outs, strict=True))


class FrequencyIndexer(Estimator, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    """Index by frequency (descending, ties by label) for columns with any number of labels."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, handleInvalid: str = "keep"):
        super().__init__()
        self._setDefault(handleInvalid="keep")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FrequencyIndexerModel:
        index = features.fit_index(dataset, self.getInputCols(), handle_invalid=self.getHandleInvalid())
        return self._copyValues(FrequencyIndexerModel(index))


class FrequencyIndexerModel(Model, _IndexParams, MLReadable, MLWritable):
    """Fitted index; ``index`` holds the label tables."""

    def __init__(self, index: features.FrequencyIndex | None = None):
        super().__init__()
        self._setDefault(handleInvalid="keep")
        self.index = index

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.index.transform(dataset, self._names())

    def write(self) -> MLWriter:
        return _IndexWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IndexReader(cls)


class _IndexWriter(MLWriter):
    def __init__(self, model: FrequencyIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.index.save(f"{path}/index")


class _IndexReader(MLReader):
    def __init__(self, cls: type[FrequencyIndexerModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FrequencyIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(features.FrequencyIndex.load(self.sparkSession, f"{path}/index"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Moded(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    mode = Param(Params._dummy(), "mode", "intended or as_written", typeConverter=TypeConverters.toString)

    def __init__(self, mode: str = "intended"):
        super().__init__()
        self._setDefault(mode="intended")
        self._set(mode=mode)

    def getMode(self) -> str:
        return self.getOrDefault(self.mode)


def _beside(dataset: DataFrame, cols: dict) -> DataFrame:
    """``dataset`` with ``cols`` (which replace columns of the same name), all read from the input's columns."""
    keep = [F.col(f"`{c}`") for c in dataset.columns if c not in cols]
    return dataset.select(*keep, *[e.alias(c) for c, e in cols.items()])


class TypedListings(_Moded):
    """Raw listings -> the typed columns and flags of workflow A."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _beside(dataset, clean.typed_columns(self.getMode()))


def cluster_columns(mode: str) -> dict:
    """Workflow B's typed columns, by name."""
    return {
        "price": price_usd("price", mode),
        "new_construction": equals_flag("new_construction", NEW_CONSTRUCTION_YES),
        "elevator": equals_flag("elevator", ELEVATOR_YES),
        "ceiling_height": ceiling_height("ceiling_height", mode),
        "rooms_int": parse_int("rooms"),
        "bathrooms_int": parse_int("bathrooms"),
    }


class ClusterColumns(_Moded):
    """Raw listings -> the typed columns of workflow B; the categories stay text."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _beside(dataset, cluster_columns(self.getMode()))


class Doubles(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Casts ``inputCols`` to double, in place; ``fill`` replaces their nulls by zero."""

    fill = Param(Params._dummy(), "fill", "replace nulls by zero", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, fill: bool = False):
        super().__init__()
        self._setDefault(fill=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = set(self.getInputCols())
        fill = self.getOrDefault(self.fill)
        as_double = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if fill else F.col(f"`{c}`").cast("double")
        return dataset.select(*[as_double(c).alias(c) if c in own else F.col(f"`{c}`") for c in dataset.columns])
