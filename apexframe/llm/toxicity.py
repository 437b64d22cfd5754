"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a step: a word (of words over PART bytes, a part of PART bytes; parts follow each other at PART_STRIDE bytes and
overlap, so every byte and every n-gram of a text is read), as a hashed word embedding beside the mean of hashed embeddings of its character n-grams (3 to 5
bytes, word ends marked), so that unseen forms of a known stem score too. Two GRUs read each window of WINDOW words in both
directions, attention pools their states, a logistic unit scores the window. Windows follow each other at STRIDE words and
overlap; every word of a text is in one, and a text scores as its worst window. Training is plain numpy (back-propagation
through time, Adam) in one task, on labelled rows up to a documented bound (TRAIN_ROWS of each class and TRAIN_WORDS words
in all, picked by hash, whole texts of up to 8 * TRAIN_WORDS / (2 * TRAIN_ROWS) words); scoring runs in Arrow batches on the executors and covers all rows and whole texts.

Defined results: null, empty and blank texts are one window without words and get the network's score for that; without any
labelled rows of both classes the network scores by the share of toxic labels (0 without labels); repeated doc_ids
are scored row by row, and labels that repeat or contradict each other for a doc_id count as their maximum; null doc_ids and
null labels are not trained on; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_CODE, _FOLD, U64, mix64, pieces, table, utf8_buffers, word_hashes, word_spans

WINDOW, STRIDE = 64, 48
PART, PART_STRIDE = 64, 48  # bytes
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 1 << 14, 8, 16, 16
NGRAMS = (3, 4, 5)
TRAIN_ROWS, TRAIN_WORDS, STEPS, BATCH, RATE = 2500, 900_000, 260, 48, 0.008
THRESHOLD = 0.3


# --- inputs -----------------------------------------------------------------------------------------------------------


def word_parts(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """(hashes, starts, ends, first) with words over PART bytes in overlapping parts; others as they are. data: lower case."""
    size = ends - starts
    if not len(size) or size.max() <= PART:
        return hashes, starts, ends, first
    count = np.where(size > PART, -(-(size - PART) // PART_STRIDE) + 1, 1)
    before = np.concatenate(([0], np.cumsum(count)))
    word = np.repeat(np.arange(len(size)), count)
    start = starts[word] + (np.arange(len(word)) - before[word]) * PART_STRIDE
    end = np.minimum(start + PART, ends[word])
    out = hashes[word]
    cut = np.flatnonzero(count[word] > 1)
    for lo in range(0, len(cut), 1 << 14):
        k = cut[lo : lo + (1 << 14)]
        at = start[k][:, None] + np.arange(PART)
        codes = np.where(at < end[k][:, None], _BYTE_CODE[data[np.minimum(at, len(data) - 1)]], U64(0))
        h = np.zeros(len(k), np.uint64)
        for c in codes.T:
            h = h * U64(_BASE) + c
        out[k] = mix64(h)
    return out, start, end, before[first]


class Words:
    """The distinct words (and parts of long words) of a batch of texts and where they stand."""

    def __init__(self, column: pa.Array):
        hashes, first = word_hashes(column)
        data, offsets = utf8_buffers(column)
        starts, ends, _ = word_spans(data, offsets)
        self.data = _FOLD[data]
        hashes, starts, ends, self.first = word_parts(self.data, hashes, starts, ends, first)
        self.hashes, at, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[at], ends[at]

    def __len__(self) -> int:
        return len(self.hashes)

    def word_rows(self) -> np.ndarray:
        return (mix64(self.hashes) & U64(WORD_ROWS - 1)).astype(np.int64)

    def char_rows(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the character n-grams of words lo to hi - 1, and each word's first (n-grams of a word adjoin)."""
        size = self.ends[lo:hi] - self.starts[lo:hi]
        width = size + 2
        base = np.cumsum(width) - width
        total = int(width.sum())
        owner = np.repeat(np.arange(hi - lo), width)
        local = np.arange(total) - base[owner]
        inside = (local > 0) & (local <= size[owner])
        codes = np.full(total, _BYTE_CODE[0], np.uint64)
        codes[inside] = _BYTE_CODE[self.data[self.starts[lo:hi][owner[inside]] + local[inside] - 1]]
        rows, owners = [], []
        for n in NGRAMS:
            at = np.flatnonzero(local <= width[owner] - n)
            h = np.full(len(at), n, np.uint64)
            for i in range(n):
                h = h * U64(_BASE) + codes[at + i]
            rows.append((mix64(h) & U64(CHAR_ROWS - 1)).astype(np.int64))
            owners.append(owner[at])
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return rows[order], np.searchsorted(owners[order], np.arange(hi - lo))


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words) of all windows, and each text's first window."""
    n = np.diff(first)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1)
    begin = np.cumsum(count) - count
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(text)) - begin[text]) * STRIDE
    return first[text] + start, np.minimum(WINDOW, n[text] - start), begin


# --- network ----------------------------------------------------------------------------------------------------------


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    return {
        "word": f(0.1, WORD_ROWS, WORD_DIM), "char": f(0.3, CHAR_ROWS, CHAR_DIM), "in": f(d**-0.5, d, 6 * h), "in_bias": np.zeros(6 * h, np.float32),
        "forth": f(h**-0.5, h, 3 * h), "back": f(h**-0.5, h, 3 * h), "attend": f(0.1, 2 * h), "out": f(0.1, 2 * h), "bias": np.full(1, -1.0, np.float32),
    }


def embed(net: dict, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input vector of each distinct word, with the n-gram rows and borders it took."""
    x = np.empty((len(words), WORD_DIM + CHAR_DIM), np.float32)
    x[:, :WORD_DIM] = net["word"][words.word_rows()]
    all_rows, all_first, seen = [], [], 0
    for lo in range(0, len(words), 20_000):
        hi = min(len(words), lo + 20_000)
        rows, first = words.char_rows(lo, hi)
        counts = np.diff(np.append(first, len(rows)))
        x[lo:hi, WORD_DIM:] = np.add.reduceat(net["char"][rows], first, axis=0) / counts[:, None]
        all_rows.append(rows)
        all_first.append(first + seen)
        seen += len(rows)
    none = np.zeros(0, np.int64)
    return x, np.concatenate(all_rows) if all_rows else none, np.concatenate(all_first) if all_first else none


def _gates(net: dict, x: np.ndarray) -> np.ndarray:
    """What each word adds to the gates of both directions; a last row of zeros stands for padding."""
    g = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
    g[:-1] = x @ net["in"] + net["in_bias"]
    return g


def _run(gates, u, h, live, tape=None):
    """One GRU over the steps of gates (T, B, 3H): states by step. live: (T, B, 1) of 0 or 1."""
    states = np.empty((len(gates), *h.shape), np.float32)
    n = HIDDEN
    for t, g in enumerate(gates):
        a = h @ u
        zr = np.tanh(0.5 * (g[:, : 2 * n] + a[:, : 2 * n])) * 0.5 + 0.5
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(g[:, 2 * n :] + r * a[:, 2 * n :])
        new = h + (live[t] * z) * (c - h)
        if tape is not None:
            tape.append((h, a, z, r, c))
        h = states[t] = new
    return states


def forward(net: dict, gates: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logit of every window; ids (B, T) into gates, the last row past a window's end."""
    b, t = ids.shape
    n = HIDDEN
    live = (np.arange(t)[:, None] < sizes[None, :]).astype(np.float32)[:, :, None]
    x = gates[ids.T]
    zero = np.zeros((b, n), np.float32)
    tapes = ([], []) if tape is not None else (None, None)
    f = _run(x[:, :, : 3 * n], net["forth"], zero, live, tapes[0])
    k = _run(x[::-1, :, 3 * n :], net["back"], zero, live[::-1], tapes[1])[::-1]
    score = f @ net["attend"][:n] + k @ net["attend"][n:]
    score = np.where(live[:, :, 0] > 0, score, -np.inf)
    top = score.max(axis=0) if t else np.zeros(b, np.float32)
    weight = np.exp(score - np.where(np.isfinite(top), top, 0)) * live[:, :, 0]
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", weight, f), np.einsum("tb,tbh->bh", weight, k)], axis=1)
    if tape is not None:
        tape.update(f=f, k=k, live=live, weight=weight, pooled=pooled, tapes=tapes)
    return pooled @ net["out"] + net["bias"][0]


def _run_back(states_grad, u, live, tape):
    """Gradients of _run: (to gates (T, B, 3H), to u)."""
    n = HIDDEN
    grad_g = np.empty((*states_grad.shape[:2], 3 * n), np.float32)
    grad_u = np.zeros_like(u)
    carry = np.zeros(states_grad.shape[1:], np.float32)
    for t in range(len(tape) - 1, -1, -1):
        h, a, z, r, c = tape[t]
        d = states_grad[t] + carry
        dm = d * live[t]
        dc = dm * z * (1 - c * c)
        g = grad_g[t]
        g[:, :n] = dm * (c - h) * z * (1 - z)
        g[:, n : 2 * n] = dc * a[:, 2 * n :] * r * (1 - r)
        g[:, 2 * n :] = dc
        da = np.concatenate([g[:, : 2 * n], dc * r], axis=1)
        grad_u += h.T @ da
        carry = d - dm * z + da @ u.T
    return grad_g, grad_u


def backward(net: dict, ids: np.ndarray, n_words: int, tape: dict, grad: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients for d loss / d logit = grad: by parameter, and to the gates of each word."""
    n, f, k, weight, live = HIDDEN, tape["f"], tape["k"], tape["weight"], tape["live"]
    out = {"out": tape["pooled"].T @ grad, "bias": grad.sum(keepdims=True)}
    dp = grad[:, None] * net["out"][None]
    dw = np.einsum("tbh,bh->tb", f, dp[:, :n]) + np.einsum("tbh,bh->tb", k, dp[:, n:])
    ds = weight * (dw - (weight * dw).sum(axis=0))
    out["attend"] = np.concatenate([np.einsum("tb,tbh->h", ds, f), np.einsum("tb,tbh->h", ds, k)])
    df = weight[:, :, None] * dp[None, :, :n] + ds[:, :, None] * net["attend"][:n]
    dk = weight[:, :, None] * dp[None, :, n:] + ds[:, :, None] * net["attend"][n:]
    gf, out["forth"] = _run_back(df, net["forth"], live, tape["tapes"][0])
    gk, out["back"] = _run_back(dk[::-1], net["back"], live[::-1], tape["tapes"][1])
    g = np.concatenate([gf, gk[::-1]], axis=2).reshape(-1, 6 * n)
    flat = ids.T.ravel()
    order = np.argsort(flat, kind="stable")
    seen, at = np.unique(flat[order], return_index=True)
    by_word = np.zeros((n_words + 1, 6 * n), np.float32)
    by_word[seen] = np.add.reduceat(g[order], at, axis=0)
    return out, by_word[:-1]


def _add_rows(n: int, rows: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(rows, c, n) for c in grad.T], axis=1).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict:
    """A network fitted to texts with labels 0 and 1. A text's loss is that of its windows, weighted to the worst."""
    net = new_network(seed)
    words = Words(pa.array(texts, pa.string()))
    start, size, first = windows_of(words.first)
    last = np.append(first[1:], len(start))
    _, char_rows, char_first = embed(net, words)
    char_last = np.append(char_first[1:], len(char_rows))
    word_rows = words.word_rows()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    rng, step = np.random.default_rng(seed), 0
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels) * 0.5 + 0.5
    while step < steps:
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            wins = np.concatenate([np.arange(first[d], last[d]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), last[docs] - first[docs])
            t = max(1, int(size[wins].max()))
            at = start[wins][:, None] + np.arange(t)
            inside = np.arange(t) < size[wins][:, None]
            seen, ids = np.unique(np.where(inside, words.ids[np.minimum(at, len(words.ids) - 1)], -1) if len(words.ids) else np.full(at.shape, -1), return_inverse=True)
            ids = ids.reshape(at.shape)
            if seen[0] == -1:  # padding goes last
                seen, ids = seen[1:], np.where(ids == 0, len(seen) - 1, ids - 1)
            counts = char_last[seen] - char_first[seen]
            rows = char_rows[np.repeat(char_first[seen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            bound = np.cumsum(counts) - counts
            x = np.empty((len(seen), WORD_DIM + CHAR_DIM), np.float32)
            x[:, :WORD_DIM] = net["word"][word_rows[seen]]
            if len(seen):
                x[:, WORD_DIM:] = np.add.reduceat(net["char"][rows], bound, axis=0) / counts[:, None]
            tape: dict = {}
            logit = forward(net, _gates(net, x), ids, size[wins], tape)
            share = np.exp((1 + 3 * step / steps) * (logit - logit.max()))
            share /= np.maximum(np.bincount(owner, share, len(docs))[owner], 1e-30)
            prob = 1 / (1 + np.exp(-logit))
            grad = (share * weight[docs][owner] * (prob - labels[docs][owner]) / len(docs)).astype(np.float32)
            grads, by_word = backward(net, ids, len(seen), tape, grad)
            grads["in"], grads["in_bias"] = x.T @ by_word, by_word.sum(axis=0)
            dx = by_word @ net["in"].T
            grads["word"] = _add_rows(WORD_ROWS, word_rows[seen], dx[:, :WORD_DIM])
            grads["char"] = _add_rows(CHAR_ROWS, rows, np.repeat(dx[:, WORD_DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0))
            step += 1
            scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g**2).sum() for k, g in grads.items() if k not in ("word", "char"))))))
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g * scale - m)
                v += 0.01 * ((g * scale) ** 2 - v)
                net[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def score_texts(net: dict, column: pa.Array) -> np.ndarray:
    """Score of every text of a batch: its worst window's."""
    words = Words(column)
    start, size, first = windows_of(words.first)
    gates = _gates(net, embed(net, words)[0])
    logit = np.empty(len(start), np.float32)
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), 1024):
        w = order[lo : lo + 1024]
        t = max(1, int(size[w].max()))
        at = np.arange(t)[None, :]
        ids = np.where(at < size[w][:, None], words.ids[np.minimum(start[w][:, None] + at, max(0, len(words.ids) - 1))] if len(words.ids) else 0, len(words))
        logit[w] = forward(net, gates, ids, size[w])
    return 1 / (1 + np.exp(-np.maximum.reduceat(logit, first).astype(np.float64))) if len(first) else np.zeros(0)


# --- Spark ------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> dict:
    """A network from labelled documents that are not held out: at most `rows` of each class, `words` words in all."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("_ax_h", F.xxhash64("doc_id", F.lit("train")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy("_ax_h", "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    longest = 8 * words // max(1, 2 * rows)  # longer texts are not in the sample
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.where(F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]+")) < longest).where(F.octet_length("text") < longest * PART_STRIDE).select("doc_id", "toxic", "_ax_h", "text")
    trained = found.repartition(1).mapInArrow(partial(_fit, words), "net binary").collect()
    return pickle.loads(trained[0][0]) if trained else constant_network(0.0)


def constant_network(share: float) -> dict:
    """Scores everything by one share."""
    net = new_network()
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    net["out"] *= 0
    net["bias"][:] = np.log(share / (1 - share))
    return net


def _fit(words: int, batches):
    """The one task that trains: its rows are the bounded sample. Keeps the driver's memory free of texts."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_ax_h", "doc_id", "text", "toxic")), strict=True)]
    texts, ys, left = [], [], words
    for _, _, text, toxic in sorted(rows, key=lambda r: r[:3]):
        left -= max(text.count(" ") + 1, len(text.encode()) // PART_STRIDE)  # parts of long words count as words
        if left < 0:
            break
        texts.append(text)
        ys.append(int(toxic == 1))
    y = np.array(ys, np.float32)
    net = train(texts, y) if 0 < y.sum() < len(y) else constant_network(float(y.mean()) if len(y) else 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def _score(sent, batches):
    net = pickle.loads(sent.value)
    for b in pieces(batches, "text", 4 << 20):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(score_texts(net, b.column("text")), 6), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, net: dict) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_score, sent), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) that score below the threshold; each row is scored and kept in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels)))

    def clean(batches):
        net = pickle.loads(sent.value)
        for b in pieces(batches, "text", 4 << 20):
            yield b.filter(pa.array(np.round(score_texts(net, b.column("text")), 6) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def op6_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
