"""Personal data by bootstrapped contextual extraction.

Base expressions give seed entities. In a first pass each text yields its
pattern-instance edges: an instance is a candidate token run (a digit or '@' in
it, spaced numbers as one), a pattern is the word before it, a slot (with '@' or
without) and the word after it, or the slot with one of the two. Spark sums the edges and scores the
graph in turns: a pattern is as good as the share of its mentions that are
already believed, an instance as good as its best pattern, and instances believed
in one turn are seeds in the next, until no pattern is added. Mentions of unseen
instances that occur nowhere else are neither for nor against a pattern, as far
as they are no more than the believed ones; those met elsewhere without belief
count against it. A pattern must also tell: its context holds believed mentions
half of the times that it stands anywhere, which function words don't. Patterns that
end above the confidence and the support discover unseen identifiers in a second pass; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE = ("email", "ip", "card", "phone")
_RE = {
    # a match can only start where a run of digits does
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NOT_DIGIT = re.compile("[^0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile("[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_WORD_AFTER = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")
#: Up to so many patterns (short strings) are sent to all executors; more are joined with the mentions by a shuffle.
BROADCAST_PATTERNS = 10_000
#: A pattern's context holds believed mentions at least this share of the times it stands anywhere.
SPECIFIC = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _good(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))
    digits = _NOT_DIGIT.sub("", s)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str):
    """[A-Za-z0-9._%+-]+@ and a dotted domain, from each '@' outwards, so that long runs cost linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", a, end
        at = text.find("@", at + 1)


def _candidates(text: str):
    """Words with a digit or '@'."""
    end = 0
    for m in _MARK.finditer(text):
        if m.start() >= end:
            a = m.start()
            while a > end and text[a - 1] not in _SPACE:
                a -= 1
            end = _REST.match(text, m.start()).end()
            yield a, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed and then start; code points, end exclusive."""
    out = list(_emails(text))
    for kind, need in zip(BASE[1:], (".", "", "+")):
        if need in text:
            out += [(kind, *m.span()) for m in _RE[kind].finditer(text) if _good(kind, m[0])]
    return out


_NUMBER = re.compile(r"[0-9 ().+/-]+")


def _joinable(text: str, a: int, b: int, c: int, d: int) -> bool:
    """Pieces of one spaced number: digits and their marks, with blanks or brackets between."""
    return c - b <= 3 and not text[b:c].strip(" ()") and bool(_NUMBER.fullmatch(text, a, b)) and bool(_NUMBER.fullmatch(text, c, d))


def _name(piece: str, most: int) -> str:
    """A short string as it is; a digest names a long one."""
    return piece if len(piece) <= most else "#" + hashlib.md5(piece.encode("utf-8", "surrogatepass")).hexdigest()


def mentions(text: str, spans: list[tuple[str, int, int]]):
    """(kind or '', start, end, instance, patterns) of base spans and other candidates.

    Candidates are words with a digit or '@', spaced numbers as one. A context is the
    whole word before or after, or the slot of the base span that stands there.
    """
    taken = sorted((a, b) for _, a, b in spans)
    free, at = [], 0
    for a, b in _candidates(text):
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        # base spans may nest, so look on from the first that ends after a
        if a < b and not any(x < b and a < y for x, y in taken[at : at + 4]) and any(c in "0123456789@" for c in text[a:b]):
            if free and _joinable(text, free[-1][1], free[-1][2], a, b):
                free[-1] = ("", free[-1][1], b)
            else:
                free.append(("", a, b))
    found = sorted([*spans, *free], key=lambda s: (s[1], s[2]))
    slots = ["[@]" if "@" in text[a:b] else "[9]" for _, a, b in found]

    def beside(i: int, apart: bool) -> str:
        kind, a, b = found[i]
        return slots[i] if kind or not apart else _name(text[a:b].lower(), 40)

    for i, (kind, a, b) in enumerate(found):
        # contexts end at the neighbouring mentions, so each stretch is walked once
        low, high = found[i - 1][2] if i else 0, found[i + 1][1] if i + 1 < len(found) else len(text)
        y = a
        while y > low and text[y - 1] in _SPACE:
            y -= 1
        x = y
        while x > low and text[x - 1] not in _SPACE:
            x -= 1
        before = _name(text[x:y].lower(), 40) if x < y else beside(i - 1, y < a) if i else "^"
        m = _WORD_AFTER.match(text, b, max(b, high))
        after = _name(m[1].lower(), 40) if m else beside(i + 1, b < high) if i + 1 < len(found) else "$"
        slot = slots[i]
        yield kind, a, b, _name(text[a:b], 64), (f"{before}\t{slot}\t", f"\t{slot}\t{after}", f"{before}\t{slot}\t{after}")


def _edges(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = {}
            for t in batch.slice(at, 512).column(0).to_pylist():
                if t:
                    for kind, _, _, instance, patterns in mentions(t, base_spans(t)):
                        for p in patterns:
                            key = (p, instance, kind)
                            rows[key] = rows.get(key, 0) + 1
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(rows.values()), pa.int64())], ["pattern", "instance", "kind", "n"])


def _token(word: str) -> str:
    return _name(word, 40)


def _contexts(wanted: frozenset[str] | None):
    """(context, seen): how often each wanted context, or any, stands around one word of whatever form."""
    sides = None if wanted is None else {side for c in wanted for side in c.split("\t")}
    pairs = wanted is None or any(all(c.split("\t")) for c in wanted)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                n: dict[str, int] = {}
                for t in batch.slice(at, 512).column(0).to_pylist():
                    words = ["^", *map(_token, _WORDS.findall((t or "").lower())), "$"]
                    for w, k in Counter(words).items():
                        if sides is None or w in sides:
                            for c in (f"{w}\t", f"\t{w}"):
                                if wanted is None or c in wanted:
                                    n[c] = n.get(c, 0) + k
                    for a, b in zip(words, words[2:]) if pairs else ():
                        if sides is None or a in sides and b in sides and f"{a}\t{b}" in wanted:
                            n[f"{a}\t{b}"] = n.get(f"{a}\t{b}", 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["context", "seen"])

    return run


def _telling(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The patterns whose context holds a believed mention at least SPECIFIC of the times that it stands in any text.

    Function words stand before identifiers now and then, and before other words far more often.
    """
    parts = F.split("pattern", "\t")
    keyed = cut(patterns.withColumn("context", F.concat_ws("\t", parts[0], parts[2])))
    contexts = keyed.select("context").distinct()
    wanted = frozenset(r.context for r in contexts.collect()) if keyed.count() <= BROADCAST_PATTERNS else None
    seen = docs.mapInArrow(_contexts(wanted), "context string, seen long").groupBy("context").agg(F.sum("seen").alias("seen"))
    out = keyed.join(seen, "context", "left").where(F.col("weight") >= SPECIFIC * F.coalesce("seen", F.lit(0)))
    return cut(out.select(*patterns.columns))


def learn_patterns(docs: DataFrame, rounds: int | None = None, confidence: float = 0.9, support: int = 5) -> DataFrame:
    """pattern, kind, score, n: all that the whole corpus' contexts teach, in so many rounds or until none is added.

    A pattern once found good stays with its kind, so the rounds end.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"))
    edges = docs.mapInArrow(_edges, "pattern string, instance string, kind string, n long")
    edges = cut(edges.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n")))
    # every mention has three patterns; a mention no base expression knows is open by the share of its instance's mentions that lie here
    total = edges.groupBy("instance").agg((F.sum("n") / 3).alias("total"))
    graph = edges.join(total, "instance").select("pattern", "instance", "kind", "n", F.when(F.col("kind") == "", F.col("n") * F.col("n") / F.col("total")).otherwise(0.0).alias("open"))
    graph = cut(graph)
    # seeds are believed in full, other instances as their best pattern is, and of its kind
    base = graph.withColumn("as_kind", F.when(F.col("kind") != "", F.col("kind"))).withColumn("trust", F.when(F.col("kind") != "", 1.0).otherwise(0.0))
    held, good, turn = base, None, 0
    while rounds is None or turn < rounds:
        turn += 1
        by_kind = held.groupBy("pattern", "as_kind").agg(
            F.sum(F.col("n") * F.col("trust")).alias("weight"), F.sum("n").alias("n"), F.sum("open").alias("open"), F.count(F.lit(1)).alias("seeds")
        )
        # a pattern belongs to the kind most of its believed mentions have
        most = F.when(F.col("as_kind").isNotNull(), F.struct("weight", "as_kind", "seeds"))
        scores = by_kind.groupBy("pattern").agg(F.max(most).alias("m"), F.sum("n").alias("n"), F.sum(F.when(F.col("as_kind").isNull(), F.col("open")).otherwise(0.0)).alias("open"))
        scores = scores.select("pattern", F.col("m.as_kind").alias("kind"), "n", F.col("m.seeds").alias("seeds"), F.col("m.weight").alias("weight"), (F.col("m.weight") / (F.col("n") - F.least("open", "m.weight"))).alias("score"))
        new = scores.where((F.col("score") >= confidence) & (F.col("seeds") >= support)).select("pattern", "kind", "score", "n", "weight")
        if good is not None:
            new = new.join(good, "pattern", "left_anti")
        new = cut(new)
        new = new if new.isEmpty() else _telling(docs, new)
        if new.isEmpty():
            return new if good is None else good
        good = new if good is None else cut(good.unionByName(new))
        belief = graph.where("kind = ''").join(good.select("pattern", F.col("kind").alias("as_kind"), "score"), "pattern").groupBy("instance")
        belief = cut(belief.agg(F.max(F.struct("score", "as_kind")).alias("b")).select("instance", F.col("b.as_kind").alias("b_kind"), F.col("b.score").alias("b_score")))
        unseen = graph.where("kind = ''").join(belief, "instance", "left")
        unseen = unseen.select("pattern", "instance", "kind", "n", "open", F.col("b_kind").alias("as_kind"), F.coalesce("b_score", F.lit(0.0)).alias("trust"))
        held = base.where("kind <> ''").unionByName(unseen)
    return good


def find_spans(text: str, patterns: dict[str, str]) -> tuple[list, list]:
    """(base spans, all spans), each by kind and then start."""
    base = base_spans(text)
    if not patterns:
        return base, base
    more = []
    for kind, a, b, _, own in mentions(text, base):
        if not kind and (hit := next((patterns[p] for p in own if p in patterns), None)):
            more.append((hit, a, b))
    return base, sorted(base + more, key=lambda s: (BASE.index(s[0]), s[1], s[2])) if more else base


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans) -> str:
    """text with every span replaced by <KIND>; of overlapping spans the union, under the first's name."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _models(batch, patterns: dict[str, str] | None):
    """The patterns for each row: the ones given, or those in the batch's last column."""
    if patterns is not None:
        return [patterns] * batch.num_rows
    return [{h["pattern"]: h["kind"] for h in own or ()} for own in batch.column(batch.num_columns - 1).to_pylist()]


def _find(patterns: dict[str, str] | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                both = [find_spans(t or "", own) for t, own in zip(b.column(1).to_pylist(), _models(b, patterns))]
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in both], pa.int64()) for kind in BASE]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([joined(found) for _, found in both], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def _mask(patterns: dict[str, str] | None, place: int, width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [t if t is None else masked(t, find_spans(t, own)[1]) for t, own in zip(b.column(place).to_pylist(), _models(b, patterns))]
                cols = list(b.columns)[:width]
                cols[place] = pa.array(texts, b.column(place).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:width])

    return run


def _asked(batches):
    """(digest of the text, pattern) of the mentions outside base spans."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            keys, asked = [], []
            for t in batch.slice(at, 512).column(0).to_pylist():
                if t and (own := {p for kind, *_, ps in mentions(t, base_spans(t)) if not kind for p in ps}):
                    keys += [hashlib.sha256(t.encode()).hexdigest()] * len(own)
                    asked += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(asked, pa.string())], ["__digest", "pattern"])


def _modelled(docs: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """docs with a last column of the patterns that each text's own mentions meet."""
    text = F.col(column).cast("string")
    asked = docs.select(text.alias("text")).mapInArrow(_asked, "__digest string, pattern string").distinct()
    met = asked.join(patterns.select("pattern", "kind"), "pattern").groupBy("__digest").agg(F.collect_list(F.struct("pattern", "kind")).alias("__met"))
    keyed = docs.withColumn("__digest", F.sha2(text, 256)).join(cut(met), "__digest", "left")
    return keyed.select(*docs.columns, "__met")


def _model(docs: DataFrame, column: str) -> tuple[DataFrame, dict[str, str] | None]:
    """(docs, the patterns), or docs with their patterns as a further column and None where there are too many to broadcast."""
    patterns = cut(learn_patterns(docs.select(F.col(column).alias("text"))))
    if patterns.count() <= BROADCAST_PATTERNS:
        return docs, {r.pattern: r.kind for r in patterns.collect()}
    return _modelled(docs, column, patterns), None


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; a row for each input row.

    Null texts count as empty; other columns are not read; repeated rows stay; texts of
    any length are searched whole, and an empty table gives no rows and no patterns. At most BROADCAST_PATTERNS patterns are sent to the executors; more are joined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, patterns = _model(docs, "text")
    return docs.mapInArrow(_find(patterns), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs, all columns kept, with every found span in `column` replaced by <KIND>; nulls stay null."""
    columns, schema = docs.columns, docs.schema
    docs, patterns = _model(docs, column)
    return docs.mapInArrow(_mask(patterns, columns.index(column), len(columns)), schema)
