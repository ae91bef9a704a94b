"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads running text in windows of its bytes, with some bytes of context on either side, and labels every byte
position of every text; a document's probabilities are the mean of its positions' probabilities. Scripts without spaces
are bytes like any others.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.bpe import slices, utf8
from corpusforge.llm.common import text_of, worker_state

#: The bounded sample it learns from: documents of a language, and windows of TRAIN_BYTES evenly spread over each.
SAMPLE_DOCUMENTS = 200
SAMPLE_WINDOWS = 8
TRAIN_BYTES = 48
#: Bytes of a window whose positions count, and of context on either side of it.
WINDOW_BYTES = 240
CONTEXT_BYTES = 16
#: State size, training.
HIDDEN = 16
STEPS = 300
BATCH = 128
RATE = 0.02
#: Windows read together.
TOGETHER = 512
#: Documents whose best language scores less are rejected by a filter.
LEAST_SCORE = 0.4
UNDETERMINED = "und"


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (n, longest), zero after a window's end, and lengths."""
    lengths = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows))
    data = np.zeros((len(windows), max(1, int(lengths.max(initial=0)))), dtype=np.uint8)
    data[np.arange(data.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(windows), dtype=np.uint8)
    return data, lengths


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Along the first axis."""
    e = np.exp(logits - logits.max(axis=0))
    e /= e.sum(axis=0)
    return e


def turned(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values (..., steps, n) with each window's own steps in the opposite order; its own inverse."""
    steps = values.shape[-2]
    if (lengths == steps).all():
        return values[..., ::-1, :]
    at = np.arange(steps)[:, None]
    at = np.where(at < lengths, lengths - 1 - at, at)
    return np.take_along_axis(values, at.reshape(*[1] * (values.ndim - 2), *at.shape), axis=-2)


class Network:
    """Parameters: for the update gate, the reset gate and the candidate (first axis) and either direction (second one)
    input weights by byte (x), recurrent weights (h) and biases (c), and for either direction an output layer (o, oc). The
    state after a byte is (1 - z) * candidate + z * state before. The backward direction reads each window from its end,
    so both take their steps together."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7, dtype: type = np.float32):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "x": random.normal(0, 0.3, (3, 2, 256, hidden)),
            "h": random.normal(0, hidden**-0.5, (3, 2, hidden, hidden)),
            "c": np.zeros((3, 2, hidden)),
            "o": random.normal(0, 0.1, (2, hidden, classes)),
            "oc": np.zeros(classes),
        }
        self.p = {name: v.astype(dtype) for name, v in self.p.items()}

    def _read(self, data: np.ndarray, lengths: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x (steps, 3, 2, n) that were read and states (steps, 2, n, hidden) after them, each direction in its own
        order; what stands after a window's end means nothing."""
        n, steps = data.shape
        k, dtype = self.hidden, self.p["o"].dtype
        columns = np.ascontiguousarray(data.T).astype(np.int64)
        both = np.stack([columns, turned(columns, lengths)], axis=1)
        rows = both[:, None] + (256 * np.arange(6)).reshape(3, 2, 1)
        # A gate is (1 + tanh(x / 2)) / 2: halved weights, and one function for all three parts.
        half = np.array([0.5, 0.5, 1], dtype=dtype).reshape(3, 1, 1, 1)
        x, u = ((self.p["x"] + self.p["c"][:, :, None]) * half).reshape(-1, k), self.p["h"] * half
        states, state = np.zeros((steps, 2, n, k), dtype=dtype), np.zeros((2, n, k), dtype=dtype)
        given, back = np.empty((3, 2, n, k), dtype=dtype), np.empty((3, 2, n, k), dtype=dtype)
        gates, (z, r, new) = given[:2], given
        for t in range(steps):
            x.take(rows[t], axis=0, out=given, mode="clip")
            np.matmul(state, u, out=back)
            gates += back[:2]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            before = back[2].copy() if tape is not None else None
            back[2] *= r
            new += back[2]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((state, z.copy(), r.copy(), new.copy(), before))
            after = states[t]
            np.subtract(state, new, out=after)
            after *= z
            after += new
            state = after
        return rows, states

    def _logits(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(classes, steps, n) by position."""
        ahead, behind = (np.ascontiguousarray(np.moveaxis(states[:, i] @ self.p["o"][i], 2, 0)) for i in (0, 1))
        ahead += turned(behind, lengths)
        ahead += self.p["oc"][:, None, None]
        return ahead

    def label(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (classes, steps, n) of every position; those after a window's end mean nothing."""
        return _softmax(self._logits(self._read(data, lengths)[1], lengths))

    def pool(self, data: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(n, classes): sums of the probabilities of each window's positions from first to before last."""
        at = np.arange(data.shape[1])[:, None]
        return (self.label(data, lengths) * ((at >= first) & (at < last))).sum(axis=1).T

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions, and its gradients by backpropagation through time."""
        k, (n, steps) = self.hidden, data.shape
        inside = np.arange(steps)[:, None] < lengths
        tape: list = []
        rows, states = self._read(data, lengths, tape)
        wrong = _softmax(self._logits(states, lengths))
        total = max(1, int(inside.sum()))
        loss = float(-(np.log(np.maximum(wrong[labels, :, np.arange(n)].T, 1e-12)) * inside).sum() / total)
        wrong[labels, :, np.arange(n)] -= 1
        wrong *= inside / wrong.dtype.type(total)
        errors = np.stack([wrong, turned(wrong, lengths)]).transpose(2, 0, 3, 1)  # (steps, 2, n, classes)
        g = {"o": np.einsum("tdnk,tdnc->dkc", states, errors), "oc": wrong.sum(axis=(1, 2))}
        into, u = errors @ self.p["o"].transpose(0, 2, 1), self.p["h"]
        g["h"], given = np.zeros_like(u), np.zeros((steps, 3, 2, n, k), dtype=u.dtype)
        later = np.zeros((2, n, k), dtype=u.dtype)
        for t in range(steps - 1, -1, -1):
            state, z, r, new, back = tape[t]
            # Nothing flows into a position after the window's end, so it passes on nothing either.
            flow = (later + into[t]) * inside[t][:, None]
            d_new = flow * (1 - z) * (1 - new * new)
            given[t] = flow * (state - new) * z * (1 - z), d_new * back * r * (1 - r), d_new
            recurrent = given[t].copy()
            recurrent[2] *= r
            g["h"] += state.transpose(0, 2, 1) @ recurrent
            later = flow * z + (recurrent @ u.transpose(0, 1, 3, 2)).sum(axis=0)
        order = np.argsort(rows, axis=None, kind="stable")
        seen, firsts = np.unique(rows.ravel()[order], return_index=True)
        flat = np.zeros((6 * 256, k), dtype=u.dtype)
        flat[seen] = np.add.reduceat(given.reshape(-1, k)[order], firsts, axis=0)
        return loss, g | {"x": flat.reshape(3, 2, 256, k), "c": given.sum(axis=(0, 3))}

    def fit(self, windows: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam on batches in which every label is as likely; returns the losses."""
        random = np.random.default_rng(seed)
        first, second = ({name: np.zeros_like(v) for name, v in self.p.items()} for _ in range(2))
        share, losses = 1 / np.bincount(labels)[labels] / len(np.unique(labels)), []
        draws = random.choice(len(windows), size=(steps, BATCH), p=share / share.sum())
        for step, drawn in enumerate(draws, 1):
            loss, g = self.gradients(*padded([windows[i] for i in drawn]), labels[drawn])
            losses.append(loss)
            rate = RATE * (1 - 0.9 * step / steps)
            for name, v in g.items():
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                self.p[name] = (self.p[name] - rate * move).astype(v.dtype)
        return losses


class Model:
    """A trained network and its languages."""

    def __init__(self, languages: list[str], network: Network | None):
        self.languages, self.network = languages, network

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(n, languages): the mean of the probabilities of all byte positions of each text; zero of an empty one."""
        data, bounds = utf8(texts)
        sizes = np.diff(bounds)
        counts = -(-sizes // WINDOW_BYTES)
        owner = np.repeat(np.arange(len(sizes)), counts)
        inner = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW_BYTES
        first, last = np.maximum(inner - CONTEXT_BYTES, 0), np.minimum(inner + WINDOW_BYTES, sizes[owner])
        lengths = np.minimum(last + CONTEXT_BYTES, sizes[owner]) - first
        sums = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(lengths, kind="stable")
        for some in (order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)):
            at = np.arange(lengths[some].max())
            inside = at < lengths[some][:, None]
            places = (bounds[owner[some]] + first[some])[:, None] + at
            windows = np.where(inside, data[np.minimum(places, len(data) - 1)], 0).astype(np.uint8)
            pooled = self.network.pool(windows, lengths[some], inner[some] - first[some], last[some] - first[some])
            np.add.at(sums, owner[some], pooled)
        return sums / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; `und` and 0 for texts without a letter."""
        known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        found = self.probabilities(pc.if_else(pa.array(known), texts, ""))
        best = found.argmax(axis=1)
        names = [self.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist())]
        return names, np.minimum(found[np.arange(len(best)), best], 1.0) * known


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> Model:
    """A model of every language in lang that some text with a letter has, from at most `documents` rows of each that
    aren't held out and at most `windows` windows of TRAIN_BYTES of each row: that is all that the driver receives."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= documents)
    data, size = F.encode("text", "UTF-8"), F.octet_length("text")
    last = F.least(F.lit(windows), F.ceil(size / TRAIN_BYTES).cast("int")) - 1
    start = lambda i: F.floor(i * F.greatest(size - TRAIN_BYTES, F.lit(0)) / F.greatest(last, F.lit(1))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, start(i) + 1, F.lit(TRAIN_BYTES)))
    # Bounded: `documents` ids of each language. Rows that share id and language count once.
    sample = rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    found = sample.select("doc_id", "lang", cut.alias("cut")).groupBy("doc_id", "lang").agg(F.min("cut").alias("cut")).collect()
    found = sorted((r.lang, bytes(window)) for r in found for window in r.cut)
    languages = sorted({name for name, _ in found})
    if not languages:
        return Model([], None)
    network = Network(len(languages))
    network.fit([window for _, window in found], np.array([languages.index(name) for name, _ in found]))
    return Model(languages, network)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each whole text, or columns `carry` of docs instead of the first two.

    `und` with score 0 for null texts, texts without a letter, and if nothing could be learned. Repeated rows and null
    ids give a row each (a null id isn't held out); an empty table gives none. Other columns are ignored.
    """
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = worker_state(key, lambda: shared.value)
        for part in slices(batches, "__text"):
            names = [c for c in part.schema.names if c != "__text"]
            found, scores = model.predict(part["__text"])
            yield pa.record_batch([*[part[c] for c in names], pa.array(found, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    own = [F.col(c) for c in carry] if carry else [F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out")]
    columns = docs.select(*own, text_of(text).alias("__text"))
    schema = columns.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return columns.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """docs whose language could be told: lang_pred isn't `und` and scores at least least_score. Null, empty and letterless
    texts go; repeated rows and rows with a null id stay or go like others; all columns stay, whatever their names."""
    model = train(docs, text, doc_id, lang)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = identify(row, model, "text", ["row"])
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
