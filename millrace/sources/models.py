"""Model files: an envelope of version, kind and parameters, as JSON text or compressed bytes."""

from __future__ import annotations

import dataclasses
import importlib
import json
import zlib
from typing import Any

import numpy as np

from .. import errors


ENVELOPE_VERSION = 1


def _plain(x: Any) -> Any:
    if isinstance(x, (np.floating, np.integer, np.bool_)):
        return x.item()
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        kind = type(x)
        if not kind.__module__.startswith("millrace.") :
            raise errors.SerializationError(reason=f"{kind.__name__} is no model of this library")
        return {"kind": f"{kind.__module__}:{kind.__qualname__}", "params": {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, tuple):
        return {"tuple": [_plain(v) for v in x]}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise errors.SerializationError(reason=f"a {type(x).__name__} can't be kept")


def _back(x: Any) -> Any:
    if isinstance(x, list):
        return [_back(v) for v in x]
    if isinstance(x, dict):
        if "tuple" in x:
            return tuple(_back(v) for v in x["tuple"])
        if "array" in x:
            return np.array(x["array"])
        module, _, name = x["kind"].partition(":")
        if not module.startswith("millrace."):
            raise errors.SerializationError(reason=f"{module} is no module of this library")
        return getattr(importlib.import_module(module), name)(**{k: _back(v) for k, v in x["params"].items()})
    return x


@dataclasses.dataclass(frozen=True)
class ModelEnvelope:
    """A model with the version of the form it is kept in."""

    model: Any
    version: int = ENVELOPE_VERSION

    def into_model(self) -> Any:
        if self.version != ENVELOPE_VERSION:
            raise errors.UnsupportedEnvelopeVersion(found=self.version, supported=ENVELOPE_VERSION)
        return self.model

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "model": _plain(self.model)})

    @staticmethod
    def from_json(text: str) -> "ModelEnvelope":
        try:
            raw = json.loads(text)
            version = raw["version"]
            # parameters of other versions are not looked at
            return ModelEnvelope(_back(raw["model"]) if version == ENVELOPE_VERSION else None, version)
        except errors.AnalyticsError:
            raise
        except Exception as e:
            raise errors.SerializationError(reason=str(e)) from None

    def to_bytes(self) -> bytes:
        return zlib.compress(self.to_json().encode())

    @staticmethod
    def from_bytes(raw: bytes) -> "ModelEnvelope":
        try:
            text = zlib.decompress(raw).decode()
        except Exception as e:
            raise errors.SerializationError(reason=str(e)) from None
        return ModelEnvelope.from_json(text)

    def save(self, path: str) -> None:
        try:
            with open(path, "wb") as f:
                f.write(self.to_bytes())
        except OSError as e:
            raise errors.IoError(reason=str(e)) from None

    @staticmethod
    def load(path: str) -> "ModelEnvelope":
        try:
            with open(path, "rb") as f:
                raw = f.read()
        except OSError as e:
            raise errors.IoError(reason=str(e)) from None
        return ModelEnvelope.from_bytes(raw)


