"""Genotype dosage of candidate sites."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources import hdf5, saved_network
from .encode import FEATURES


def standardized(x: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std, entry by entry."""
    both = F.zip_with(x, F.array(*map(F.lit, mean)), lambda a, m: a.cast("double") - m)
    return F.zip_with(both, F.array(*map(F.lit, std)), lambda a, s: a / s)


def binomial_probabilities(rd: Column, alt_num: Column, ploidy: int, error: float = 0.01) -> Column:
    """Probabilities of 0 to ploidy alternative copies, from a binomial likelihood and a flat prior."""
    logs = []
    for k in range(ploidy + 1):
        q = (k / ploidy) * (1 - error) + (1 - k / ploidy) * error
        logs.append(alt_num * F.lit(float(np.log(q))) + (rd - alt_num) * F.lit(float(np.log(1 - q))))
    most = F.greatest(*logs)
    parts = [F.exp(x - most) for x in logs]
    total = sum(parts[1:], parts[0])
    return F.array(*[x / total for x in parts])


def dosage(probabilities: Column) -> tuple[Column, Column]:
    """The largest probability and its class; of equal ones the first."""
    most = F.array_max(probabilities)
    return most.alias("pred_prob"), (F.array_position(probabilities, most) - 1).cast("int").alias("pred_label")


def binomial_scores(candidates: DataFrame, ploidy: int, error: float = 0.01) -> DataFrame:
    """candidates with pred_prob and pred_label by the binomial scorer."""
    scored = candidates.withColumn("_p", binomial_probabilities(F.col("rd"), F.col("alt_num"), ploidy, error))
    return scored.select("*", *dosage(F.col("_p"))).drop("_p")


def read_statistics(path: str) -> tuple[list[float], list[float]]:
    """Mean and std of the tensors' entries from a statistics file: .npz, or HDF5."""
    if path.endswith(".npz"):
        with np.load(path) as f:
            mean, std = f["mean"], f["std"]
    else:
        mean, std = hdf5.read_arrays(path, ("mean", "std"))
    return np.ravel(mean).astype(float).tolist(), np.ravel(std).astype(float).tolist()


Predictor = Callable[[np.ndarray], np.ndarray]


def batch_scores(encoded: DataFrame, make_predictor: Callable[[], Predictor], window: int, mean: list[float] | None = None, std: list[float] | None = None, batch_size: int = 8192) -> DataFrame:
    """encoded sites with pred_prob and pred_label by a model on x, reshaped to (2 * window + 1, 30).

    make_predictor runs once a Python worker and returns a function from a batch of
    standardized tensors to class probabilities.
    """
    width = 2 * window + 1

    def load():
        predict = make_predictor()
        centre = np.zeros(width * len(FEATURES), np.float32) if mean is None else np.asarray(mean, np.float32)
        scale = np.ones(width * len(FEATURES), np.float32) if std is None else np.asarray(std, np.float32)
        shape = (width, len(FEATURES))
        return lambda x: predict((np.asarray(x, np.float32) - centre.reshape(shape)) / scale.reshape(shape)).astype(np.float32)

    udf = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[width, len(FEATURES)]])
    scored = encoded.withColumn("_p", udf("x"))
    return scored.select("*", *dosage(F.col("_p"))).drop("_p", "x")


def seeded_dense(window: int, ploidy: int, seed: int = 1) -> Callable[[], Predictor]:
    """A small dense network with weights drawn from a seed: for tests of shapes, not for calling."""

    def make() -> Predictor:
        draw = np.random.default_rng(seed)
        one = draw.standard_normal(((2 * window + 1) * len(FEATURES), 16)).astype(np.float32) * 0.05
        two = draw.standard_normal((16, ploidy + 1)).astype(np.float32)

        def predict(x: np.ndarray) -> np.ndarray:
            z = np.maximum(np.log1p(np.abs(x.reshape(len(x), -1))) @ one, 0) @ two
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make


def linear(weights: np.ndarray) -> Callable[[], Predictor]:
    """Softmax of the flat tensor times a matrix (entries, classes)."""

    def make() -> Predictor:
        def predict(x: np.ndarray) -> np.ndarray:
            z = x.reshape(len(x), -1).astype(np.float64) @ weights
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make


def model_predictor(path: str) -> Callable[[], Predictor]:
    """A model file for onnxruntime, or the folder of a saved network."""
    return saved_network.saved_predictor(path) if os.path.isdir(path) else onnx_predictor(path)


def onnx_predictor(path: str) -> Callable[[], Predictor]:
    """A model file for onnxruntime: one input (n, columns, 30), one output of probabilities."""

    def make() -> Predictor:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return make
