"""Language identification by a byte-level convolutional network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import map_arrow, set_columns, shield, slices, with_columns
from plantmon.plans.staging import stage

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4, 5)
FILTERS = 4  # of each width
EMBEDDING = 8
UNKNOWN = "und"
# ASCII other than letters says nothing about a language.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_CHUNK = 64  # windows per step, so that their activations stay in the cache


def cleaned(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def windows_of(data: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes, the last one padded with zeros."""
    rows = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    """Embedding, filters of several widths in one zero-padded bank, softmax layer."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # max width x EMBEDDING x bank
    offset: np.ndarray  # bank
    weights: np.ndarray  # bank x languages
    bias: np.ndarray

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """The same network with its linear part tabulated.

    Embedding and convolution are linear in each byte, so a filter's response at
    a place is a sum of table entries, two bytes at a time.
    """

    def __init__(self, net: Network):
        width = len(net.filters)
        tables = [net.embedding @ net.filters[j] for j in range(width)]
        self.pairs = []
        for j in range(0, width - 1, 2):
            self.pairs.append((j, (tables[j][:, None, :] + tables[j + 1][None, :, :]).reshape(65536, -1)))
        self.last = (width - 1, tables[width - 1]) if width % 2 else None
        self.width, self.net = width, net

    def features(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.offset)), np.float32)
        for a in range(0, len(windows), _CHUNK):
            part = windows[a : a + _CHUNK]
            padded = np.zeros((len(part), WINDOW + self.width), np.int32)
            padded[:, :WINDOW] = part
            both = (padded[:, :-1] << 8) + padded[:, 1:]
            total = None
            for j, table in self.pairs:
                found = table[both[:, j : j + WINDOW]]
                total = found if total is None else np.add(total, found, out=total)
            if self.last:
                j, table = self.last
                total += table[padded[:, j : j + WINDOW]]
            out[a : a + _CHUNK] = total.max(axis=1)
        return np.maximum(out + self.net.offset, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.features(windows) @ self.net.weights + self.net.bias
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64,
    rate: float = 0.01, seed: int = 7,
) -> Network:
    """Fit the network with Adam on cross entropy.

    Max pooling passes a gradient only to the best place of each filter, so the
    backward pass touches one place per window and filter.
    """
    draw = np.random.default_rng(seed)
    top, bank = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((top, 1, bank), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    p = {
        "embedding": draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "filters": (draw.normal(0, 0.3, (top, EMBEDDING, bank)) * mask).astype(np.float32),
        "offset": np.zeros(bank, np.float32),
        "weights": draw.normal(0, 0.3, (bank, len(languages))).astype(np.float32),
        "bias": np.zeros(len(languages), np.float32),
    }
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            x, y = windows[rows].astype(np.int64), labels[rows]
            n = len(rows)
            padded = np.zeros((n, WINDOW + top), np.int64)
            padded[:, :WINDOW] = x
            places = np.lib.stride_tricks.sliding_window_view(padded, top, axis=1)[:, :WINDOW]
            shown = p["embedding"][places]  # n, WINDOW, top, EMBEDDING
            response = shown.reshape(n * WINDOW, -1) @ p["filters"].reshape(-1, bank)
            response = response.reshape(n, WINDOW, bank)
            best = response.argmax(axis=1)
            pooled = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + p["offset"]
            active = np.maximum(pooled, 0)
            logits = active @ p["weights"] + p["bias"]
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            wrong = odds / odds.sum(axis=1, keepdims=True)
            wrong[np.arange(n), y] -= 1
            wrong /= n
            back = (wrong @ p["weights"].T) * (pooled > 0)
            seen = shown[np.arange(n)[:, None], best]  # n, bank, top, EMBEDDING
            g = {
                "weights": active.T @ wrong, "bias": wrong.sum(axis=0), "offset": back.sum(axis=0),
                "filters": np.einsum("nf,nfje->jef", back, seen) * mask, "embedding": np.zeros_like(p["embedding"]),
            }
            to_embedding = np.einsum("nf,jef->nfje", back, p["filters"])
            np.add.at(g["embedding"], places[np.arange(n)[:, None], best], to_embedding)
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, **p)


def training_windows(
    labelled: DataFrame, text_col: str, lang_col: str, order: Column, per_language: int, per_text: int
) -> list[tuple[str, bytes]]:
    """A bounded draw of labelled windows: ``per_language`` texts of each language at most.

    The texts of a language are drawn by hash, whatever other languages there
    are, and a few windows of each by their place. A first draw takes four times
    as many as wanted where there are more, so that few texts move; of these the
    smallest hashes count.
    """
    rows = labelled.where(F.col(text_col).rlike(r"\p{L}")).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), order.alias("at")
    )
    counts = labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    shares = stage(counts.select("lang", (F.lit(4.0 * per_language) / F.col("n")).alias("share")), "shares")
    rows = rows.join(shares, "lang").where(F.pmod("at", F.lit(1_000_003)) / F.lit(1_000_003) < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    drawn = rows.withColumn("place", place).where(F.col("place") <= per_language).select("text", "lang", "at")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, ats, rows = [], [], []
            for text, lang, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not has_letter(text):
                    continue
                found = windows_of(cleaned(text))
                for i in sorted({at % len(found), (at >> 20) % len(found), len(found) // 2})[:per_text]:
                    langs.append(lang)
                    ats.append(at)
                    rows.append(found[i].tobytes())
                # A short clip as well, for texts of a few words.
                langs.append(lang)
                ats.append(at)
                rows.append(found[0].tobytes()[: 6 + at % 64].ljust(WINDOW, b"\0"))
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ats, pa.int64()), pa.array(rows, pa.binary())],
                names=["lang", "at", "bytes"],
            )

        return cut

    rows = map_arrow(drawn, "lang string, at long, bytes binary", make)
    return [(r["lang"], bytes(r["bytes"])) for r in rows.orderBy("at", "bytes").collect()]


def fit_language_id(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 800, per_text: int = 2,
) -> Network | None:
    """Train on a bounded sample of the labelled rows; None if there is nothing to learn.

    ``per_language`` texts of every language are drawn at most, and ``per_text``
    windows and a short clip of each; this bounds what the driver holds for a
    language. Every value of the language column is learned. Rows without text,
    letters or language are left out.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = training_windows(known, text_col, lang_col, F.xxhash64(id_col, text_col), per_language, per_text)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    windows = np.stack([np.frombuffer(b, np.uint8) for _, b in rows])
    labels = np.asarray([languages.index(lang) for lang, _ in rows])
    return train(windows, labels, languages)


def predict_language(
    docs: DataFrame, network: Network | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score"
) -> DataFrame:
    """Language of every whole text.

    Returns the input columns plus the predicted language and its score, the mean
    probability over all windows of the text, weighted by their bytes. Null texts
    and texts without a letter get ``und`` and score 0, as do all texts where
    there is no network. An empty table gives an empty table. Nothing moves: the
    network is a few thousand numbers.
    """
    docs, back = shield(docs, [text_col])
    schema = with_columns([(lang_name, T.StringType()), (score_name, T.DoubleType())], docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = network.compiled() if network else None

        def part(texts: list[str | None]) -> list[tuple[str, float]]:
            answers = [(UNKNOWN, 0.0)] * len(texts)
            rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
            if not rows:
                return answers
            data = [cleaned(texts[i]) or texts[i].encode() for i in rows]
            cut = [windows_of(d) for d in data]
            chances = model.probabilities(np.concatenate(cut)).astype(np.float64)
            heads = np.cumsum([0, *[len(c) for c in cut[:-1]]])
            weight = np.concatenate([
                np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(c))) for d, c in zip(data, cut, strict=True)
            ]).astype(np.float64)
            mean = np.add.reduceat(chances * weight[:, None], heads) / np.add.reduceat(weight, heads)[:, None]
            for i, row in zip(rows, mean, strict=True):
                best = int(row.argmax())
                answers[i] = (network.languages[best], float(min(1.0, row[best])))
            return answers

        def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.names.index(text_col))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)) + 1
            found = []
            for s in slices(sizes, 4_000_000):
                found += part(column[s].to_pylist())
            return set_columns(batch, {
                lang_name: pa.array([lang for lang, _ in found], pa.string()),
                score_name: pa.array([score for _, score in found], pa.float64()),
            })

        return predict

    return back(map_arrow(docs, schema, make), [lang_name, score_name])


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def query(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out third, predict all of them."""
    docs = docs.select("doc_id", "text", "lang")
    network = fit_language_id(docs.where(fold("doc_id", 3) != 1))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return predict_language(rows, network).select("doc_id", "held_out", "lang_pred", "score")
