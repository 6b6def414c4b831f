"""Language ID by a small convolutional network over bytes, trained here in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 run over fixed-length windows, each filter's greatest response goes
to a softmax. It learns from one window each of at most SAMPLE labelled documents (those of least hash, a bound that
doesn't follow the corpus). A prediction reads the whole text in overlapping windows; a document's score is the mean
probability of its windows, weighted by their letters.

Edge cases: null text, or text without a letter, is `und` with score 0; with no labelled document to learn from all
are `und`; a null doc_id isn't held out, and is not learned from either; repeated rows are judged alike."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

UND = "und"
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4), 12, 8
SAMPLE, EPOCHS, BATCH, RATE, SEED = 4096, 8, 64, 3e-3, 5
#: The pipeline keeps documents with this score or more.
KEEP_SCORE = 0.4


def byte_classes() -> tuple[np.ndarray, int]:
    """Byte to class: letters without case, bytes of multi-byte characters, and 0 for all else."""
    table = np.zeros(256, np.int32)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(1, 27)
    table[0x80:0xF5] = np.arange(27, 27 + 0xF5 - 0x80)
    return table, 27 + 0xF5 - 0x80


def windows_of(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """(windows, size) classes of all bytes; neighbours share the bytes that the widest filter needs."""
    step = size - (max(WIDTHS) - 1)
    n = max(1, -(-(len(data) - (max(WIDTHS) - 1)) // step))
    padded = np.zeros((n - 1) * step + size, data.dtype)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step]


class Network:
    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, (self.table, n) = labels, byte_classes()
        self.p = {"E": rng.normal(0, 0.3, (n, EMBEDDED)), "O": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"W{w}"], self.p[f"b{w}"] = rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """x: (windows, WINDOW) classes; y: label numbers. Adam on the cross entropy."""
        rng = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                t += 1
                for k, g in self._gradients(x[part], y[part]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, len(x)
        emb = p["E"][x]  # (n, WINDOW, EMBEDDED)
        tops, places, parts = [], [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDED)
            out = patches @ p[f"W{w}"]
            place = out.argmax(axis=1)
            tops.append(np.maximum(np.take_along_axis(out, place[:, None], 1)[:, 0] + p[f"b{w}"], 0))
            places.append(place)
            parts.append(patches)
        hidden = np.concatenate(tops, axis=1)
        share = softmax(hidden @ p["O"] + p["c"])
        share[np.arange(n), y] -= 1
        share /= n
        g = {"O": hidden.T @ share, "c": share.sum(0), "E": np.zeros_like(p["E"])}
        back = (share @ p["O"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]  # (n, FILTERS)
            chosen = parts[i][rows, places[i]]  # (n, FILTERS, w * EMBEDDED)
            g[f"W{w}"] = np.einsum("nf,nfe->ef", own, chosen)
            g[f"b{w}"] = own.sum(0)
            into = (own[..., None] * p[f"W{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDED)
            for j in range(w):
                np.add.at(g["E"], x[rows, places[i] + j].ravel(), into[:, :, j].reshape(-1, EMBEDDED))
        return g

    def tables(self) -> dict:
        """Responses of each filter to pairs and single classes, so that a window is scored by lookups."""
        out, n = {}, len(self.p["E"])
        for w in WIDTHS:
            parts = [self.p["E"] @ self.p[f"W{w}"][j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)]
            out[w] = [(parts[j][:, None] + parts[j + 1][None]).reshape(n * n, FILTERS) for j in range(0, w - 1, 2)] + ([parts[-1]] if w % 2 else [])
        return out

    def shares(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """(windows, labels) probabilities."""
        n = len(self.p["E"])
        pairs = x[:, :-1] * n + x[:, 1:]
        tops = []
        for w in WIDTHS:
            length = x.shape[1] - w + 1
            total = np.take(tables[w][0], pairs[:, :length], axis=0)
            for j in range(2, w, 2):
                total += np.take(tables[w][j // 2], pairs[:, j : j + length] if j + 1 < w else x[:, j : j + length], axis=0)
            tops.append(np.maximum(total.max(axis=1) + self.p[f"b{w}"], 0))
        return softmax(np.concatenate(tops, axis=1) @ self.p["O"] + self.p["c"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learns from `sample` windows at most, of labelled documents that aren't held out."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out())
    order = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 1)  # even over 63 bits
    # tasks would each send `sample` rows; so only about twice the sample's least hashes are looked at
    share = min(1.0, 2 * sample / max(1, known.select("doc_id").count()))
    rows = _least(known, order, order <= F.lit((int(share * (1 << 53)) << 10) - 1), sample)
    if share < 1 and len(rows) < sample:  # many texts are null
        rows = _least(known, order, F.lit(True), sample)
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    net = Network(labels)
    x = np.stack([windows_of(net.table[np.frombuffer(r["text"].encode()[:WINDOW], np.uint8)])[0] for r in rows])
    net.fit(x, np.array([labels.index(r["lang"]) for r in rows]))
    return net


def _least(known: DataFrame, order, few, sample: int) -> list:
    """lang and one window of each of the `sample` documents of least order."""
    text = F.col("text").cast("string")
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - WINDOW + 1, F.lit(1)))
    cut = known.where(few & F.col("text").isNotNull()).select("lang", order.alias("o"), "doc_id", F.substring(text, (begin + 1).cast("int"), F.lit(WINDOW)).alias("text"))
    return cut.orderBy("o", "doc_id", "lang", "text").limit(sample).select("lang", "text").collect()


def identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with text gets lang_pred and score; other columns stay."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UND)).withColumn("score", F.lit(0.0))
    token, state = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((net.labels, net.p))

    def work(batch):
        net, tables = _opened(token, state)
        raw, off = common.bytes_of(batch.column("text"))
        data = net.table[raw]
        letter = (data > 0) & (data < 27)
        counts = np.r_[0, np.cumsum(letter)]
        labels, scores = [], []
        texts = None
        wins, owner = [], []
        for i in range(batch.num_rows):
            a, b = off[i], off[i + 1]
            if b > a and counts[b] == counts[a] and (raw[a:b] >= 0x80).any():
                texts = batch.column("text").to_pylist() if texts is None else texts
                some = any(map(str.isalpha, texts[i]))
            else:
                some = counts[b] > counts[a]
            if some:
                w = windows_of(data[a:b])
                wins.append(w)
                owner += [i] * len(w)
        total = np.zeros((batch.num_rows, len(net.labels)))
        if wins:
            owner, at = np.array(owner), 0
            for x in pieces(wins):
                weights = 1e-6 + ((x > 0) & (x < 27)).sum(axis=1) + 0.5 * (x >= 27).sum(axis=1)
                np.add.at(total, owner[at : at + len(x)], net.shares(x, tables) * weights[:, None])
                at += len(x)
        for i in range(batch.num_rows):
            s = total[i].sum()
            labels.append(net.labels[int(total[i].argmax())] if s > 0 else UND)
            scores.append(float(total[i].max() / s) if s > 0 else 0.0)
        return {c: batch.column(c) for c in names} | {"lang_pred": labels, "score": scores}

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return common.arrow_map(docs, schema + ", lang_pred string, score double", work)


def pieces(wins: list, most: int = 512):
    """Windows of several documents together, at most `most` at once."""
    held, n = [], 0
    for w in wins:
        for at in range(0, len(w), most):
            part = w[at : at + most]
            if n + len(part) > most:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield np.concatenate(held)


_OPEN: dict = {}


def _opened(token: str, state) -> tuple[Network, dict]:
    """The network and its tables, made once in each worker."""
    if token not in _OPEN:
        labels, p = state.value
        net = Network(labels)
        net.p = p
        _OPEN.clear()
        _OPEN[token] = (net, net.tables())
    return _OPEN[token]


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = trained(docs.select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays unclear; where no document is labelled nothing is
    known of languages, and only those without a letter go."""
    net = trained(docs.select("doc_id", "text", "lang"))
    if net is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}")).select("doc_id", "text", "lang", "source", "n_chars")
    seen = identified(docs.select("doc_id", "text", "lang", "source", "n_chars"), net)
    return seen.where((F.col("lang_pred") != UND) & (F.col("score") >= KEEP_SCORE)).select("doc_id", "text", "lang", "source", "n_chars")
