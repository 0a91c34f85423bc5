"""Toxicity by compression distance: one zstandard dictionary of toxic, one of ordinary text.

Every window (six words without punctuation, a space at either side) is compressed once with either dictionary. A window
that the toxic dictionary shortens by at least a calibrated margin is a hit; the score is a logistic function, fitted on
training rows that the dictionaries have not seen, of how many windows hit and of their share.

The dictionaries are content dictionaries: words in order of frequency, the commonest last; the toxic one is the ordinary one
with the words of toxic texts behind it, so that ordinary text gains nothing. (zstandard's
own trainer did worse in trials with other windows; see the README.)

Null and empty texts have no windows: they get the score of a text without hits. Repeated rows get equal scores, and equal scores
are left as ties. A null id counts as an empty one for held_out. A very long text is compressed window by window. Only doc_id and
text are read, so that no other column can clash. Without labels of both classes no text is toxic. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows of each class are fitted on, the first by a hash of doc_id.
MAX_PER_CLASS = 1500
ORDINARY_BYTES, TOXIC_BYTES = 1 << 18, 1 << 13
#: A word is toxic if so large a share of the toxic training texts has it (three texts at least; the share that does best on
#: the held rows is taken), and so many times the share of the ordinary ones.
LEAST_SHARES, LEAST_RATIO = (0.005, 0.01, 0.02, 0.04), 20
LEVEL = 3
#: Words of a window, and its most bytes.
WINDOW, LONGEST_WINDOW = 6, 256
#: A hit that gains so much more than the margin is a clear one.
CLEAR = 3


#: ASCII that is no letter, to spaces.
BARE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def bare(text: bytes) -> list[bytes]:
    """The text's words in lower case without digits and punctuation."""
    return text.lower().translate(BARE).split()


def windows(own: list[bytes]):
    """WINDOW words each, and at most LONGEST_WINDOW bytes, so that a window is short whatever a word is."""
    for i in range(0, len(own), WINDOW):
        text = b" " + b" ".join(own[i : i + WINDOW]) + b" "
        if len(text) <= LONGEST_WINDOW:
            yield text
        else:
            for k in range(0, len(text), LONGEST_WINDOW):
                yield text[k : k + LONGEST_WINDOW]


def squeezer(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Gains:
    """Of each window (length with the ordinary dictionary) - (length with the toxic one)."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = squeezer(toxic).compress, squeezer(ordinary).compress

    def __call__(self, text: bytes) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(bare(text))], int)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    margin: int
    weights: tuple[float, ...]

    def features(self, text: bytes, gains: Gains) -> tuple[int, int, int]:
        own = gains(text)
        return len(own), int((own >= self.margin).sum()), int((own >= self.margin + CLEAR).sum())

    def score(self, counted: np.ndarray) -> np.ndarray:
        """counted: (windows, hits, clear hits) a row."""
        z = inputs(counted) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(counted: np.ndarray) -> np.ndarray:
    n, hits, clear = counted.T
    return np.column_stack([np.ones(len(n)), np.log1p(hits), np.log1p(clear), 100 * clear / np.maximum(n, 1), np.log1p(n)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(counts: Counter, most: int) -> bytes:
    """The windows, the commonest last, where zstandard finds them at the least cost."""
    return (b"  " + b" ".join(w for w, _ in sorted(counts.items(), key=lambda x: (x[1], x[0]))) + b" ")[-most:].rjust(8)


def without_copies(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """The rows of which at least half of the shingles of five words are new: copies would make any word look typical."""
    seen: set[int] = set()
    out = []
    for text, label in rows:
        own = bare(text)
        shingles = {hash(tuple(own[i : i + 5])) for i in range(max(1, len(own) - 4))}
        if 2 * len(shingles & seen) <= len(shingles):
            out.append((text, label))
        seen |= shingles
    return out


def train(rows: list[tuple[bytes, int]]) -> Model:
    """rows: (UTF-8 text, 1 if toxic). Two thirds make the dictionaries, the rest the margin and the weights."""
    rows = without_copies(rows)
    made, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    counts = {0: Counter(), 1: Counter()}
    for text, label in made:
        counts[label].update(set(bare(text)))
    n = [max(1, sum(label == k for _, label in made)) for k in (0, 1)]
    y = np.array([label for _, label in held], float)
    best = None
    for least in sorted({max(3, share * n[1]) for share in LEAST_SHARES}):
        toxic = Counter({w: k for w, k in counts[1].items() if k >= least and k * n[0] >= LEAST_RATIO * counts[0][w] * n[1]})
        ordinary = Counter({w: k for w, k in (counts[0] + counts[1]).items() if w not in toxic})
        plain = dictionary(ordinary, ORDINARY_BYTES)
        model = Model(plain + dictionary(toxic, TOXIC_BYTES), plain, 1, (-2.0, 0.0, 0.0, 0.0, 0.0))
        if not 0 < y.sum() < len(y):
            return model
        gains = Gains(model.toxic, model.ordinary)
        own = [gains(text) for text, _ in held]
        for margin in range(1, 9):
            x = inputs(np.array([(len(g), (g >= margin).sum(), (g >= margin + CLEAR).sum()) for g in own], float))
            w = logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if best is None or loss < best[0] - 1e-4:
                model.margin, model.weights = margin, tuple(map(float, w))
                best = loss, replace(model)
    return best[1]


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """At most MAX_PER_CLASS rows of either class, none of them held out."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(MAX_PER_CLASS).unionByName(usable.where("toxic = 0").orderBy(*order).limit(MAX_PER_CLASS))
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    # of texts with the same id the least: however many rows share it, the sample stays as large
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(bytes(r.text), r.toxic) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, n_hits, n_clear of every row."""

    def scored(batches):
        gains = Gains(model.toxic, model.ordinary)
        for batch in batches:
            texts = batch.column("text")
            counted = np.array([model.features(t.as_py() or b"", gains) for t in texts], float).reshape(-1, 3)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(counted))]
            columns += [pa.array(counted[:, i].astype("int64")) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "n_windows", "n_hits", "n_clear"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    rows = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, n_windows long, n_hits long, n_clear long")
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_windows", "n_hits", "n_clear")
