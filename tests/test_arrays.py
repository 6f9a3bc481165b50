"""Array files of all kinds: MATLAB 5 files are written here byte by byte."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import arrays as A
from tidewave.sources import arrays, matlab

NUMBER = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}
CLASS = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}


def element(kind, content, order="<", small=True):
    if small and len(content) <= 4:
        return struct.pack(order + "I", len(content) << 16 | kind) + content.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def matrix(name, a, order="<", stored=None, cls=None):
    """stored: the number type of the values, if smaller than that of their class."""
    part = a.real if np.iscomplexobj(a) else a
    kind = cls or part.dtype.str[1:]
    numbers = lambda x: element(NUMBER[stored or x.dtype.str[1:]], np.asarray(x, dtype=np.dtype(stored or x.dtype).newbyteorder(order)).ravel(order="F").tobytes(), order)
    body = element(6, struct.pack(order + "II", CLASS.get(kind, 4) | (0x0800 if np.iscomplexobj(a) else 0), 0), order)
    body += element(5, struct.pack(order + f"{a.ndim}i", *a.shape), order) + element(1, name.encode(), order) + numbers(part)
    if np.iscomplexobj(a):
        body += numbers(a.imag)
    return element(14, body, order, small=False)


def mat(*parts, order="<", packed=False):
    head = b"made by hand".ljust(124) + (b"\x00\x01IM" if order == "<" else b"\x01\x00MI")
    if packed:
        parts = [struct.pack(order + "II", 15, len(z := zlib.compress(p))) + z for p in parts]
    return head + b"".join(parts)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_variables_come_back(order, packed):
    rng = np.random.default_rng(1)
    complex_ = rng.normal(size=(3, 4, 5)) + 1j * rng.normal(size=(3, 4, 5))
    floats, ints = rng.normal(size=(2, 3)).astype("f4"), rng.integers(-9, 9, (4, 1)).astype("i2")
    text = element(14, element(6, struct.pack(order + "II", 4, 0), order) + element(5, struct.pack(order + "2i", 1, 2), order) + element(1, b"t", order) + element(4, np.array([104, 105], "u2").tobytes(), order), order, small=False)
    small = np.arange(6.0).reshape(2, 3)
    data = mat(matrix("csi", complex_, order), text, matrix("a_long_name_here", floats, order), matrix("n", ints, order), matrix("s", small, order, stored="u1", cls="f8"), order=order, packed=packed)
    got = matlab.variables(data)
    assert [*got] == ["csi", "a_long_name_here", "n", "s"]
    for name, want in (("csi", complex_), ("a_long_name_here", floats), ("n", ints), ("s", small)):
        assert got[name].shape == want.shape and (got[name] == want).all() and got[name].dtype.kind == want.dtype.kind


def test_damaged_files_are_an_error():
    whole = mat(matrix("csi", np.arange(40.0).reshape(4, 10)), packed=True)
    for data in (b"", b"x" * 200, whole[:-5], whole[:140] + b"\xff" * 8 + whole[148:], mat(struct.pack("<II", 14, 999) + b"abc")):
        with pytest.raises(ValueError):
            matlab.variables(data)


def written(path, name, a, key="csi"):
    if name.endswith(".npy"):
        np.save(path / name, a)
    elif name.endswith(".npz"):
        np.savez(path / name, other=np.zeros(3), **{key: a})
    else:
        (path / name).write_bytes(mat(matrix("_meta", np.zeros((1, 1))), matrix("other", np.zeros((1, 3))), matrix(key, a), packed="z" in name))


def rows_of(df):
    return sorted((r.t_idx, r.rx, r.ant, r.re, r.im) for r in df.collect())


def test_narrow_files_of_every_kind_are_equal(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 30, 3, 3)) + 1j * rng.normal(size=(4, 30, 3, 3))  # T F M A
    kinds = {"a.npy": base.reshape(4, 270), "b.npz": base.transpose(0, 2, 3, 1)[:, None], "c.mat": base, "d_z.mat": base.transpose(0, 2, 3, 1)}
    for name, a in kinds.items():
        written(tmp_path, name, a)
    written(tmp_path, "e.mat", base, key="WiFiCSI")
    (tmp_path / "z.npy").write_bytes(b"broken")
    (tmp_path / "z.mat").write_bytes(b"broken")
    (tmp_path / "z.npz").write_bytes(b"PK broken")
    written(tmp_path, "y.npy", np.zeros((2, 31)))
    df = arrays.read_arrays(spark, str(tmp_path))
    files = [r.path for r in df.select("path").distinct().collect()]
    assert sorted(f[-5:] for f in files) == ["a.npy", "b.npz", "c.mat", "e.mat", "z.mat"] and any(f.endswith("d_z.mat") for f in files)
    want = rows_of(df.where(F.col("path").endswith("a.npy")))
    assert len(want) == 4 * 3 * 4 and want[0][3] == base.real[0, :, 0, 0].tolist()
    for f in files:
        assert rows_of(df.where(F.col("path") == f)) == want
    assert df.where("ant = 3").select(A.total(F.col("re")).alias("s")).where("s <> 0").isEmpty()


def test_the_wide_shapes():
    base = np.arange(2 * 2048 * 3).reshape(2, 2048, 3)
    for a in (base, base.transpose(0, 2, 1), base[:, None], base.transpose(0, 2, 1).reshape(2, 1, 3, 2048)):
        assert (arrays.wide(a) == base).all()
    assert (arrays.wide(base[:, :, 0])[:, :, 0] == base[:, :, 0]).all() and arrays.wide(base[0, 0]) is None
    streams = np.arange(2 * 2 * 3 * 2048).reshape(2, 2, 3, 2048)
    assert arrays.wide(streams).shape == (2, 2048, 6) and (arrays.wide(streams)[:, :, 4] == streams[:, 1, 1]).all()


def test_wide_files_and_times(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 20, 2)) + 0j
    written(tmp_path, "a.npy", base)
    written(tmp_path, "b.mat", base.transpose(0, 2, 1), key="CSI")
    df = arrays.read_arrays(spark, str(tmp_path), shape="wide", receiver=2, rate=150.0)
    a, b = (rows_of(df.where(F.col("path").endswith(n))) for n in ("a.npy", "b.mat"))
    assert a == b and len(a) == 600 * 4 and {r[1] for r in a} == {2}
    last = df.where("t_idx = 599 and ant = 1").first()
    assert last.ts == 599 / 150.0 and last.re == pytest.approx(base.real[599, :, 1].tolist())
    assert df.where("ts = 0").count() == 8


def test_npz_takes_its_key_or_the_first():
    def packed(**a):
        with io.BytesIO() as b:
            np.savez(b, **a)
            return b.getvalue()

    assert arrays.load(packed(data=np.ones(2), csi=np.zeros(2)), "x.npz")[0] == 0
    assert arrays.load(packed(first=np.ones(2), data=np.zeros(2)), "x.npz")[0] == 1
    with pytest.raises(ValueError):
        arrays.load(mat(matrix("_only", np.zeros((1, 1)))), "x.mat")
