"""Saved networks and HDF5 statistics: made files, byte by byte as the formats are described, against plain loops."""

import json
import math
import struct
import zlib

import numpy as np
import pytest

from ploidyflow.config import ConfigError, model_files
from ploidyflow.operators import scoring
from ploidyflow.sources import hdf5, saved_network

# ----------------------------------------------------------------- saved network


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*pairs):
    out = b""
    for number, value in pairs:
        out += varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value
    return out


def table_block(rows):
    """A block of sorted keys, each stored as what differs from the one before."""
    out, before = b"", b""
    for key, value in rows:
        same = 0
        while same < min(len(before), len(key)) and before[same] == key[same]:
            same += 1
        out += varint(same) + varint(len(key) - same) + varint(len(value)) + key[same:] + value
        before = key
    return out + struct.pack("<II", 0, 1)


def write_bundle(prefix, arrays, blocks=2):
    """Variables in two data files and an index of some blocks."""
    data, rows = [b"", b""], [(b"", message((1, 2)))]
    for k, (name, x) in enumerate(sorted(arrays.items())):
        kind = {"float32": 1, "float64": 2, "int64": 9}[str(x.dtype)]
        shape = b"".join(message((2, message((1, n)))) for n in x.shape)
        rows.append(((name + saved_network.SUFFIX).encode(), message((1, kind), (2, shape), (3, k % 2), (4, len(data[k % 2])), (5, x.nbytes)) + varint(6 << 3 | 5) + b"\0\0\0\0"))
        data[k % 2] += x.tobytes()
    rows.append((b"zz_object_graph", message((1, 7), (5, 3))))
    out, handles = b"", []
    for part in np.array_split(np.arange(len(rows)), blocks):
        block = table_block([rows[i] for i in part])
        handles.append((rows[part[-1]][0], varint(len(out)) + varint(len(block))))
        out += block + b"\0" + b"\0\0\0\0"
    index = table_block(handles)
    footer = varint(0) + varint(0) + varint(len(out)) + varint(len(index))
    out += index + b"\0" * 5 + footer.ljust(40, b"\0") + struct.pack("<Q", saved_network.MAGIC)
    with open(f"{prefix}.index", "wb") as f:
        f.write(out)
    for k in (0, 1):
        with open(f"{prefix}.data-{k:05d}-of-00002", "wb") as f:
            f.write(data[k])


def write_network(folder, layers, arrays):
    (folder / "variables").mkdir(parents=True)
    write_bundle(str(folder / "variables" / "variables"), arrays)
    root = json.dumps({"class_name": "Sequential", "config": {"name": "s", "layers": layers}}).encode()
    nodes = [message((2, 0), (3, b"root"), (4, b"_tf_keras_sequential"), (5, root)), message((2, 1), (3, b"root.layer-0"), (4, b"x"), (5, b"{}"))]
    (folder / "keras_metadata.pb").write_bytes(b"".join(message((1, x)) for x in nodes))


def plain_lstm(x, kernel, recurrent, bias):
    """One window's outputs, number by number."""
    units = len(recurrent)
    h, c, out = [0.0] * units, [0.0] * units, []
    gate = lambda v: 1 / (1 + math.exp(-v))
    for step in x:
        z = [sum(step[i] * kernel[i][j] for i in range(len(step))) + sum(h[i] * recurrent[i][j] for i in range(units)) + bias[j] for j in range(4 * units)]
        c = [gate(z[units + u]) * c[u] + gate(z[u]) * math.tanh(z[2 * units + u]) for u in range(units)]
        h = [gate(z[3 * units + u]) * math.tanh(c[u]) for u in range(units)]
        out.append(h)
    return out


def made(seed, features=30, units=(4, 3), classes=5):
    draw = np.random.default_rng(seed)
    arrays, width = {}, features
    for k, n in enumerate(units):
        for side in ("forward", "backward"):
            base = f"layer_with_weights-{k}/{side}_layer/cell"
            arrays |= {f"{base}/kernel": draw.normal(0, 0.3, (width, 4 * n)), f"{base}/recurrent_kernel": draw.normal(0, 0.3, (n, 4 * n)), f"{base}/bias": draw.normal(0, 0.3, 4 * n)}
        width = 2 * n
    arrays |= {"layer_with_weights-2/gamma": draw.normal(1, 0.1, width), "layer_with_weights-2/beta": draw.normal(0, 0.1, width), "layer_with_weights-2/moving_mean": draw.normal(0, 0.1, width), "layer_with_weights-2/moving_variance": draw.random(width) + 0.5}
    arrays |= {"layer_with_weights-3/kernel": draw.normal(0, 1, (width, 6)), "layer_with_weights-3/bias": draw.normal(0, 1, 6), "layer_with_weights-4/kernel": draw.normal(0, 1, (6, classes)), "layer_with_weights-4/bias": draw.normal(0, 1, classes)}
    rnn = lambda name, n, whole: {"class_name": "Bidirectional", "config": {"name": name, "merge_mode": "concat", "layer": {"class_name": "LSTM", "config": {"units": n, "return_sequences": whole, "activation": "tanh", "recurrent_activation": "sigmoid"}}}}
    layers = [
        {"class_name": "InputLayer", "config": {"name": "in"}}, rnn("a", units[0], True), {"class_name": "Dropout", "config": {"rate": 0.5}}, rnn("b", units[1], False),
        {"class_name": "BatchNormalization", "config": {"epsilon": 0.001}}, {"class_name": "Dense", "config": {"activation": "relu"}}, {"class_name": "Dense", "config": {"activation": "softmax"}},
    ]
    return layers, {k: v.astype(np.float32) for k, v in arrays.items()} | {"save_counter": np.array(3)}


def plain_network(x, arrays):
    get = lambda name: arrays[name].astype(float).tolist()
    for k, whole in ((0, True), (1, False)):
        sides = [plain_lstm(steps, *(get(f"layer_with_weights-{k}/{side}_layer/cell/{w}") for w in ("kernel", "recurrent_kernel", "bias"))) for side, steps in (("forward", x), ("backward", x[::-1]))]
        x = [a + b for a, b in zip(sides[0], sides[1][::-1], strict=True)] if whole else sides[0][-1] + sides[1][-1]
    g, b, m, v = (get(f"layer_with_weights-2/{w}") for w in ("gamma", "beta", "moving_mean", "moving_variance"))
    x = [(x[i] - m[i]) / math.sqrt(v[i] + 0.001) * g[i] + b[i] for i in range(len(x))]
    for k, last in ((3, False), (4, True)):
        kernel, bias = get(f"layer_with_weights-{k}/kernel"), get(f"layer_with_weights-{k}/bias")
        z = [sum(x[i] * kernel[i][j] for i in range(len(x))) + bias[j] for j in range(len(bias))]
        x = [math.exp(a - max(z)) / sum(math.exp(y - max(z)) for y in z) for a in z] if last else [max(a, 0) for a in z]
    return x


def test_variables(tmp_path):
    arrays = {"a/kernel": np.arange(6, dtype=np.float32).reshape(2, 3), "a/kernel2": np.array([1.5, -2.0]), "b": np.array(7), "empty": np.zeros((0, 4), np.float32)}
    for blocks in (1, 3):
        write_bundle(str(tmp_path / "v"), arrays, blocks)
        got = saved_network.read_variables(str(tmp_path / "v"))
        assert set(got) == set(arrays) and all((got[k] == v).all() and got[k].dtype == v.dtype and got[k].shape == v.shape for k, v in arrays.items())
    (tmp_path / "x.index").write_bytes(b"no table" * 10)
    with pytest.raises(ConfigError, match="no index"):
        saved_network.read_variables(str(tmp_path / "x"))


def test_network_against_plain_loops(spark, tmp_path):
    layers, arrays = made(1)
    write_network(tmp_path / "model", layers, arrays)
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (9, 5, 30)).astype(np.float32)
    want = np.array([plain_network(w.astype(float).tolist(), arrays) for w in x])
    assert scoring.model_predictor(str(tmp_path / "model"))()(x) == pytest.approx(want, abs=1e-5)
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "k int, x array<float>")
    got = scoring.batch_scores(df, scoring.model_predictor(str(tmp_path / "model")), 2, batch_size=4).orderBy("k").collect()
    assert [r.pred_label for r in got] == want.argmax(axis=1).tolist() and [r.pred_prob for r in got] == pytest.approx(want.max(axis=1), abs=1e-5)
    (tmp_path / "statistics.h5").write_bytes(b"")
    assert model_files(str(tmp_path)) == (str(tmp_path / "model"), str(tmp_path / "statistics.h5"))


def test_networks_that_are_not_read(tmp_path):
    layers, arrays = made(3)
    for k, (wrong, why) in enumerate(((layers + [{"class_name": "Conv1D", "config": {}}], "not known"), (layers[:-1] + [{"class_name": "Dense", "config": {"activation": "swish9"}}], "not known"), (layers + [layers[-1]], "none of layer"), ([dict(x, inbound_nodes=[[1, 2]]) for x in layers], "one line"))):
        write_network(tmp_path / f"m{k}", wrong, arrays)
        with pytest.raises(ConfigError, match=why):
            saved_network.saved_predictor(str(tmp_path / f"m{k}"))


# -------------------------------------------------------------------------- HDF5


class Made:
    """An HDF5 file of the default version, put together from its parts."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, body):
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += body
        return at

    def header(self, messages, apart=0):
        """An object header; the last messages may stand in a block of their own."""
        pack = lambda own: b"".join(struct.pack("<HHB3x", kind, len(body) + -len(body) % 8, 0) + body + b"\0" * (-len(body) % 8) for kind, body in own)
        first = messages[: len(messages) - apart]
        if apart:
            rest = pack(messages[-apart:])
            first = [*first, (hdf5.CONTINUED, struct.pack("<QQ", self.put(rest), len(rest)))]
        body = pack(first)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    @staticmethod
    def kind(x):
        size = x.dtype.itemsize
        order = x.dtype.byteorder == ">"
        if x.dtype.kind == "f":
            return struct.pack("<4BI", 0x11, 0x20 | order, 8 * size - 1, 0, size) + bytes(12)
        return struct.pack("<4BI", 0x10, order | 8 * (x.dtype.kind == "i"), 0, 0, size) + bytes(4)

    def array(self, x, how="contiguous", chunk=None, apart=0):
        space = struct.pack("<4B4x", 1, x.ndim, 0, 0) + struct.pack(f"<{x.ndim}Q", *x.shape)
        messages = [(hdf5.SPACE, space), (hdf5.TYPE, self.kind(x))]
        if how == "contiguous":
            messages.append((hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        elif how == "compact":
            messages.append((hdf5.LAYOUT, struct.pack("<BBH", 3, 0, x.nbytes) + x.tobytes()))
        else:
            keys = []
            for begin in np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunk, strict=True))):
                at = [b * c for b, c in zip(begin, chunk, strict=True)]
                piece = np.zeros(chunk, x.dtype)
                part = x[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))]
                piece[tuple(slice(0, n) for n in part.shape)] = part
                raw = piece.tobytes()
                if how == "deflated":
                    raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
                keys.append(struct.pack("<II", len(raw), 0) + struct.pack(f"<{x.ndim + 1}Q", *at, 0) + struct.pack("<Q", self.put(raw)))
            half = len(keys) // 2
            leaves = [self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(k), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(k)) for k in (keys[:half], keys[half:]) if k]
            top = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(bytes(8 + 8 * (x.ndim + 1)) + struct.pack("<Q", a) for a in leaves))
            messages.append((hdf5.LAYOUT, struct.pack("<BBBQ", 3, 2, x.ndim + 1, top) + struct.pack(f"<{x.ndim + 1}I", *chunk, x.dtype.itemsize)))
            if how == "deflated":
                messages.insert(2, (hdf5.FILTERS, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", hdf5.SHUFFLE, 0, 1, 1, x.dtype.itemsize) + struct.pack("<HHHH8sI4x", hdf5.DEFLATE, 8, 1, 1, b"deflate\0", 4)))
        return self.header(messages, apart)

    def file(self, arrays):
        names, entries = bytearray(8), b""
        for name, header in sorted(arrays.items()):
            entries += struct.pack("<QQ24x", len(names), header)
            names += name.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        segment = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, segment))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(arrays)) + entries)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<QQQ", 0, node, 8))
        root = self.header([(hdf5.TABLE, struct.pack("<QQ", tree, heap))])
        self.data[:96] = hdf5.SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(self.data), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 1, 0)
        return bytes(self.data)


@pytest.mark.parametrize("how", ["contiguous", "compact", "chunked", "deflated"])
@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i2"])
def test_arrays(tmp_path, how, kind):
    draw = np.random.default_rng(4)
    mean, std = (draw.normal(0, 50, (7, 30)).astype(kind) for _ in range(2))
    own = Made()
    (tmp_path / "s.h5").write_bytes(own.file({"mean": own.array(mean, how, (4, 16)), "std": own.array(std, how, (3, 30), apart=1), "other": own.array(mean[0], "contiguous")}))
    got = hdf5.read_arrays(str(tmp_path / "s.h5"), ("mean", "std"))
    assert (got[0] == mean).all() and (got[1] == std).all() and got[0].shape == mean.shape
    as_lists = scoring.read_statistics(str(tmp_path / "s.h5"))
    assert as_lists == (mean.astype(float).ravel().tolist(), std.astype(float).ravel().tolist())
    with pytest.raises(hdf5.Hdf5Error, match="has no absent"):
        hdf5.read_arrays(str(tmp_path / "s.h5"), ("absent",))


def test_files_that_are_not_read(tmp_path):
    for body in (b"", b"plain text", hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + bytes(60)):
        (tmp_path / "x.h5").write_bytes(body)
        with pytest.raises(hdf5.Hdf5Error):
            hdf5.read_arrays(str(tmp_path / "x.h5"), ("mean",))
