"""Saving of fitted stages that Spark's own writers do not know."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class Saved(MLWritable, MLReadable):
    """A fitted stage kept as its parameters, a small state of plain values and stages inside it.

    A class gives ``_state`` and ``_parts`` and takes both back in ``_rebuilt``.
    """

    def _state(self) -> dict:
        return {}

    def _parts(self) -> list:
        return []

    @classmethod
    def _rebuilt(cls, state: dict, parts: list):
        return cls(**state)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: Saved):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        parts = self.stage._parts()
        extra = {"state": self.stage._state(), "parts": len(parts)}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=extra)
        for i, part in enumerate(parts):
            part.write().session(self.sparkSession).save(f"{path}/parts/{i}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = [
            DefaultParamsReader.loadParamsInstance(f"{path}/parts/{i}", self.sparkSession) for i in range(found["parts"])
        ]
        stage = self.kind._rebuilt(found["state"], parts)
        stage._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(stage, found)
        return stage
