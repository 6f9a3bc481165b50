"""Fill-in-middle: texts cut in three and reordered for training on infilling.

A text is stored as maximal runs of characters of one class, the class being the
number of bytes that UTF-8 takes for each; a run has the number of units (code
points) before it. The run that a cut falls in is found by binary search, and the
byte where to cut by arithmetic, so no text is decoded into characters.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_FLAT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Runs:
    """Runs of all texts of a batch: bytes and units (code points) before each, and the bytes of a unit."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(begins, len(data)))
        #: units before each text, and of all
        self.before = np.searchsorted(begins, offs)
        change = np.ones(len(begins), bool)
        change[1:] = width[1:] != width[:-1]
        inner = self.before[:-1]
        change[inner[inner < len(begins)]] = True
        self.unit = np.flatnonzero(change)
        self.byte, self.width = begins[self.unit], width[self.unit]

    def bytes_at(self, units: np.ndarray) -> np.ndarray:
        """The byte where each unit, counted over the batch, begins (or the end)."""
        if not len(self.unit):
            return np.zeros(len(units), np.int64)
        run = np.searchsorted(self.unit, units, "right") - 1
        return self.byte[run] + (units - self.unit[run]) * self.width[run]


def _draws(ids, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.array([struct.unpack(">4I", d) for d in digests], np.int64).reshape(-1, 4)


def _transform(seed: int, plain_percent: int, spm_percent: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, offs = buffers(batch.column(1))
                runs = Runs(data, offs)
                n = np.diff(runs.before)
                h = _draws(batch.column(0).to_pylist(), seed)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                ends = [runs.bytes_at(runs.before[:-1] + cuts[:, i]) for i in (0, 1)]
                raw, forms, outputs = data.tobytes(), [], []
                for i in range(len(n)):
                    a, b, c, d = int(offs[i]), int(ends[0][i]), int(ends[1][i]), int(offs[i + 1])
                    text = raw[a:d]
                    if a == d or _P in text or _S in text or _M in text or h[i, 2] % 100 >= 100 - plain_percent:
                        forms.append("plain")
                        outputs.append(text)
                    elif h[i, 3] % 100 < spm_percent:
                        forms.append("spm")
                        outputs.append(b"".join((_S, raw[c:d], _P, raw[a:b], _M, raw[b:c])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((_P, raw[a:b], _S, raw[c:d], _M, raw[b:c])))
                plain = np.array([f == "plain" for f in forms], bool)
                middle = cuts[:, 1] - cuts[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output; a row for each input row.

    Cuts and form follow from the sha256 of seed:doc_id, so equal rows have equal
    output (a null id counts as no digits). plain texts, among them all that are null,
    empty or hold a mark, stay as they are and have null lengths. Any length of text
    takes memory in proportion to it alone. Other columns are not read; an empty
    table stays empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_transform(seed, plain_percent, spm_percent), _FLAT)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: no part holds a mark, so the first of each kind is the one that was set."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    one = _until(body, first)
    rest = F.substring(body, F.length(one) + 1 + len(SUFFIX), F.length(body))
    two = _until(rest, second)
    middle = F.substring(rest, F.length(two) + 1 + len(MIDDLE), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def _until(text: Column, mark: Column) -> Column:
    return F.substring(text, F.lit(1), F.instr(text, mark) - 1)
