"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search reads characters one at a time and keeps, for the last m positions
(m: the longest piece), the backpointer of the one best path that ends there.
Any later piece starts at one of them, so when the paths from all of them meet
in one earlier boundary, every id before it is final and is committed.

Unigram models keep the path of the highest score. In a BPE model the last
piece of a prefix's encoding is unique: it is the piece that stays apart from
the last piece before it when the two are merged alone. That test takes the
place of the score; the ids equal those of merging by rank. Characters outside
the vocabulary become byte pieces, or the unknown id, and nothing joins them.

No piece holds a word mark after another character (checked at load), so all
paths meet before each run of marks. Segments between such points are encoded
once per task and remembered. The streams of a BPE model's short segments, which
fit the window, go side by side: all read their first characters, then all their
second ones, with one array for the backpointers of all.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_SEGMENT = re.compile(" *[^ ]+| +")
#: Segments in each of two generations, about 200 bytes each.
_REMEMBERED = 300_000
#: Of one left piece, at most so many verdicts are remembered.
MAX_FOLLOWERS = 2_000
#: Segments of at most so many characters go side by side, so many characters in all at once.
SHORT, ABREAST = 64, 200_000
#: Verdicts that the streams side by side remember; the table has twice as many places of 12 bytes.
MAX_VERDICTS = 1 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, bytes, or 4 raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and flags of a serialised model."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.bpe, self.dummy, self.squeeze, self.escape, self.charsmap = False, True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
        if self.charsmap or self.squeeze or not self.escape:
            raise ValueError("only models with identity normalisation are read")
        usable = (_NORMAL, _USER)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in usable}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.least = min(self.scores) - 10
        #: node: character -> node, and "" -> the piece that ends here
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.words_end = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.output = [b"" if k == _CONTROL else bytes([int(p[3:5], 16)]) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self._apart: dict[str, dict[str, bool]] = {}
        self._split: dict[str, tuple[str, str] | None] = {}
        self._made: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank of a short string, the leftmost first on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                id_ = self.ids.get(parts[i] + parts[i + 1])
                if id_ is not None and (best is None or self.scores[id_] > best):
                    best, at = self.scores[id_], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if it is a character or never made."""
        if piece not in self._split:
            parts, two = list(piece), None
            while len(parts) > 1:
                ranked = [(self.scores[i], -at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None]
                if not ranked:
                    break
                at = -max(ranked)[1]
                two = (parts[at], parts[at + 1])
                parts[at : at + 2] = ["".join(two)]
            self._split[piece] = two if len(parts) == 1 else None
            self._made[piece] = len(parts) == 1
        return self._split[piece]

    def after(self, left: str) -> dict[str, bool]:
        """What is known of the pieces that may follow `left`: whether the two stay apart."""
        known = self._apart.get(left)
        if known is None:
            known = self._apart[left] = {}
        return known

    def judge(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether the two pieces stay as they are when merged together.

        Merges across the border are looked for from the last step backwards: of
        the two sides, the one merged last is taken apart, and a join across the
        border counts if its rank comes before that merge.
        """
        if len(known) > MAX_FOLLOWERS:
            known.clear()
        known[right] = self._apart_test(left if left in self.ids else "", right)
        return known[right]

    def _apart_test(self, left: str, right: str) -> bool:
        self._parts(right)
        if not self._made[right]:
            return False
        if not left:
            return True
        if right[0] == MARK or left[-1] == MARK:  # ranks of runs of marks tie; order decides
            return self.merged(left + right) == [left, right]
        score, ids, none = self.scores, self.ids, float("-inf")
        floor, inclusive = none, False
        while True:
            joint = ids.get(left + right)
            if joint is not None and (score[joint] > floor or inclusive and score[joint] == floor):
                return False
            a, b = self._parts(left), self._parts(right)
            if a is None and b is None:
                return True
            # at equal ranks the left one is merged first
            if b is None or a is not None and score[ids[left]] < score[ids[right]]:
                floor, inclusive, left = score[ids[left]], False, a[1]
            else:
                floor, inclusive, right = score[ids[right]], True, b[0]

    def char_ids(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


class Stream:
    """Feed characters; `out` gets pieces as they become final."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # not yet committed
        #: for each position of the text: the last piece of its best path, or None where no path ends
        self.best: list[str | None] = [""]
        #: unigram models: the paths' scores
        self.score: list[float] = [0.0]
        #: unfinished pieces: (where it starts, its trie node, verdicts on what may follow the piece before it)
        self.open: list[tuple[int, dict, dict]] = [(0, model.trie, model.after(""))]
        self.out: list[str] = []
        self.most = 0

    def feed(self, chars: str) -> None:
        m = self.model
        for c in chars:
            self.text += c
            found, best, still, end = None, self.best, [], len(self.best)
            if m.bpe:
                for entry in self.open:
                    node = entry[1].get(c)
                    if node is not None:
                        still.append((entry[0], node, entry[2]))
                        piece = node.get("")
                        if piece is not None and found is None:
                            apart = entry[2].get(piece)
                            if apart is None:
                                apart = m.judge(best[entry[0]], piece, entry[2])
                            if apart:
                                found = piece
                if found is None and c not in m.ids and best[-1] is not None:
                    found = c
            else:
                top = 0.0
                for a, node, after in self.open:
                    node = node.get(c)
                    if node is not None:
                        still.append((a, node, after))
                        piece = node.get("")
                        if piece is not None and (found is None or self.score[a] + m.scores[m.ids[piece]] > top):
                            found, top = piece, self.score[a] + m.scores[m.ids[piece]]
                if c not in m.ids and best[-1] is not None and (found is None or self.score[-1] + m.least > top):
                    found, top = c, self.score[-1] + m.least
                self.score.append(top)
            best.append(found)
            if found is not None:
                still.append((end, m.trie, m.after(found if found in m.ids else "")))
            self.open = still
            if end >= m.longest or len(still) == 1:
                self.most = max(self.most, end)
                self._commit()

    def _commit(self) -> None:
        """Cut at the last boundary that the paths of all unfinished pieces share."""
        points = {entry[0] for entry in self.open}
        while len(points) > 1:
            last = max(points)
            points.remove(last)
            points.add(last - len(self.best[last]))
        if points and (cut := points.pop()):
            self._take(cut)
            self.best = self.best[cut:]
            if not self.model.bpe:
                self.score = [x - self.score[cut] for x in self.score[cut:]]
            self.open = [(a - cut, node, after) for a, node, after in self.open]
            self.text = self.text[cut:]

    def _take(self, end: int) -> None:
        path = []
        while end:
            path.append(self.best[end])
            end -= len(path[-1])
        self.out += reversed(path)

    def close(self) -> list[str]:
        out = self.out
        self._take(len(self.text))
        self.__init__(self.model)
        return out


def viterbi(model: Model, segment: str) -> list[int]:
    stream = Stream(model)
    stream.feed(segment)
    out: list[int] = []
    for piece in stream.close():
        id_ = model.ids.get(piece)
        out += [id_] if id_ is not None else model.char_ids(piece)
    return out


class Table:
    """Non-negative int64 names and int32 values by open addressing; many are looked up or added at a time."""

    def __init__(self, places: int):
        self.names, self.values, self.size = np.full(places, -1, np.int64), np.zeros(places, np.int32), 0
        self.shift = np.uint64(65 - places.bit_length())

    def _place(self, names: np.ndarray) -> np.ndarray:
        return (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, names: np.ndarray) -> np.ndarray:
        """Values; -1 where there is none."""
        at = self._place(names)
        held = self.names[at]
        out = np.where(held == names, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != names) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.names) - 1)
            held = self.names[at[left]]
            same = held == names[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def put(self, names: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct names that are not yet there; half of the places stay free."""
        at = self._place(names)
        self.size += len(names)
        while len(names):
            free = self.names[at] < 0
            self.names[at[free]] = names[free]
            done = self.names[at] == names
            self.values[at[done]] = values[done]
            names, values, at = names[~done], values[~done], (at[~done] + 1) & (len(self.names) - 1)


class Abreast:
    """The streams of many short segments of a BPE model, side by side."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces = [*model.ids]
        self.start = len(self.pieces)  # no piece before: the begin of a segment, or a character outside the vocabulary
        self.lone = self.start + 1
        self.number = np.array([*model.ids.values(), 0, 0], "<i4")
        self.length = np.array([*map(len, self.pieces), 0, 1], np.int64)
        edges: dict[int, int] = {}
        ends = [-1]
        for i, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                name = node << 21 | ord(c)
                node = edges.setdefault(name, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.edges = Table(2 << len(edges).bit_length())
        self.edges.put(np.array([*edges], np.int64), np.array([*edges.values()], np.int32))
        self.verdicts = Table(2 * MAX_VERDICTS)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        names = left * self.start + right
        out = self.verdicts.get(names)
        if (out < 0).any():
            new = np.unique(names[out < 0])
            if self.verdicts.size + len(new) > MAX_VERDICTS:
                self.verdicts = Table(len(self.verdicts.names))
                new = np.unique(names)
            judged = [self.model._apart_test(self.pieces[a] if a < self.start else "", self.pieces[b]) for a, b in zip(*(x.tolist() for x in np.divmod(new, self.start)))]
            self.verdicts.put(new, np.array(judged, np.int32))
            out = self.verdicts.get(names)
        return out == 1

    def encode(self, segments: list[str]) -> list[bytes]:
        """int32 ids of each segment, none of them empty."""
        m, stop = self.model, (1 << 21) - 1  # no code point
        sizes = np.array([*map(len, segments)], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        total = int(begins[-1] + sizes[-1])
        chars = np.full(total + 1 + m.longest, stop, np.int64)
        inside = np.ones(total, bool)
        inside[begins[1:] - 1] = False
        at = np.flatnonzero(inside)
        chars[at] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        offset = at - np.repeat(begins, sizes)
        # every piece that stands anywhere
        live, node, found, single = np.arange(len(at)), np.zeros(len(at), np.int64), [], np.zeros(len(at), bool)
        for n in range(m.longest):
            node = self.edges.get(node << 21 | chars[at[live] + n]).astype(np.int64)
            on = node >= 0
            live, node = live[on], node[on]
            if not len(live):
                break
            piece = self.ends[node]
            hit = piece >= 0
            found.append((live[hit], piece[hit]))
            if n == 0:
                single[live[hit]] = True
        alone = np.flatnonzero(~single)
        found.append((alone, np.full(len(alone), self.lone)))
        start, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(offset[start].astype(np.uint8), kind="stable")
        turns = np.searchsorted(offset[start[order]], np.arange(int(sizes.max()) + 1))
        start, piece = at[start[order]], piece[order]
        end = start + self.length[piece]
        # all streams read their first character, then all their second one
        best = np.full(total + 1, -1, np.int64)
        best[begins] = self.start
        for i, j in zip(turns[:-1].tolist(), turns[1:].tolist()):
            left, e, right = best[start[i:j]], end[i:j], piece[i:j]
            open_ = np.flatnonzero((left >= 0) & (best[e] < 0))
            left, e, right = np.minimum(left[open_], self.start), e[open_], right[open_]
            known = right < self.start
            best[e[~known]] = right[~known]
            left, e, right = left[known], e[known], right[known]
            apart = self._apart(left, right)
            best[e[apart]] = right[apart]
        # back from the ends
        taken, place, first = np.zeros(total + 1, bool), begins + sizes, begins
        while len(place):
            if (best[place] < 0).any():
                raise ValueError("a text without a path")
            taken[place] = True
            place = place - self.length[best[place]]
            going = place > first
            place, first = place[going], first[going]
        taken = np.flatnonzero(taken)
        piece = best[taken]
        ids, many = self.number[piece], np.ones(len(piece), np.int64)
        alone = np.flatnonzero(piece == self.lone)
        lone = [m.char_ids(chr(c)) for c in chars[taken[alone] - 1].tolist()]
        many[alone] = [*map(len, lone)]
        ids, alone = np.repeat(ids, many), np.repeat(piece == self.lone, many)
        ids[alone] = [i for x in lone for i in x]
        raw = ids.tobytes()
        upto = 4 * np.concatenate([[0], np.cumsum(many)])[np.searchsorted(taken, begins + sizes, "right")]
        return [raw[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]


class Codec:
    """Encodes and decodes whole texts; the ids of frequent segments are remembered."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.abreast = Abreast(self.model) if self.model.bpe and self.model.words_end else None
        #: two generations of remembered segments: what is asked for again moves to the new one
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _segment(self, s: str) -> bytes:
        ids = self.seen.get(s) or self.old.get(s)
        if ids is None:
            ids = np.array(viterbi(self.model, s.replace(" ", MARK)), "<i4").tobytes()
        self._remember(s, ids)
        return ids

    def _remember(self, s: str, ids: bytes) -> None:
        if len(s) <= SHORT:
            if len(self.seen) >= _REMEMBERED:
                self.old, self.seen = self.seen, {}
            self.seen[s] = ids

    def _learn(self, segments: set[str]) -> None:
        """Encodes those not remembered side by side."""
        held, size = [], 0
        for s in segments:
            ids = self.old.get(s)
            if ids is not None:
                self._remember(s, ids)
            elif len(s) <= SHORT:
                held.append(s.replace(" ", MARK))
                size += len(s)
                if size >= ABREAST:
                    self._abreast(held)
                    held, size = [], 0
        if held:
            self._abreast(held)

    def _abreast(self, marked: list[str]) -> None:
        for s, ids in zip(marked, self.abreast.encode(marked)):
            self._remember(s.replace(MARK, " "), ids)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text; a word mark of the text itself counts as a space."""
        out, dummy = [], " " * self.model.dummy
        texts = [dummy + t.replace(MARK, " ") if t else "" for t in texts]
        parts = [_SEGMENT.findall(t) if self.model.words_end else [t] * bool(t) for t in texts]
        if self.abreast:
            self._learn(set().union(*parts).difference(self.seen))
        for p in parts:
            found = [*map(self.seen.get, p)]
            if None in found:
                found = [self._segment(s) if ids is None else ids for s, ids in zip(p, found)]
            out.append(np.frombuffer(b"".join(found), "<i4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.model.output.__getitem__, ids.tolist()))
        if self.model.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    """The vocabulary file, read on the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: The codec of this worker process and the digest of its model: tasks that follow go on with what it remembers.
_CODEC: dict[str, Codec] = {}


def worker_codec(data: bytes) -> Codec:
    name = _sha(data)
    if name not in _CODEC:
        _CODEC.clear()
        _CODEC[name] = Codec(data)
    return _CODEC[name]


def _run(data: bytes):
    def run(batches):
        codec = worker_codec(data)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                whole, texts, own = [t or "" for t in b.column(1).to_pylist()], [], []
                ids = codec.encode_all(whole)
                for t, found in zip(whole, ids):
                    back = codec.decode(found)
                    own.append(back == t.replace(MARK, " "))
                    texts.append(_sha(back.encode("utf-8", "surrogatepass")))
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids)))
                digest = pa.array([_sha(x.tobytes()) for x in ids])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), flat, digest, pa.array(texts), pa.array(own)], ["doc_id", "n_ids", "ids", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def encode_decode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256, decoded_sha256, round_trip; a row for each input row.

    Null texts count as empty, which has no ids; repeated rows stay; an empty table gives
    no rows; texts of any length are encoded whole in a window's memory. round_trip
    says that decoding gives the text again, with word marks read as spaces.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(read_model(model_path)), "doc_id long, n_ids long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")
