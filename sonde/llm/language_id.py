"""Operator 1: language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table, texts_to_python

#: Bytes of a window: the recurrence begins anew in each, in training and in use.
WINDOW = 128


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _cell(a: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step over columns: input part ``a`` (3H, B), weights ``u`` (3H, H), state ``h`` (H, B)."""
    n_h = len(h)
    g = u @ h
    zr = _sigmoid(a[: 2 * n_h] + g[: 2 * n_h])
    z, r = zr[:n_h], zr[n_h:]
    n = np.tanh(a[2 * n_h :] + r * g[2 * n_h :])
    return n + z * (h - n), z, r, n, g


@dataclass
class Network:
    """Weights of both directions: ``w`` (3H, 256) by byte, ``u`` (3H, H), ``v`` (C, H); ``c`` (C, 1) for the output."""

    langs: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    v: list[np.ndarray]
    c: np.ndarray

    def positions(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Language probabilities (T, C, B) of every byte of windows ``x`` (T, B); sizes descend."""
        t_n, b_n = x.shape
        c_n, h_n = len(self.langs), self.u[0].shape[1]
        out = np.empty((t_n, c_n, b_n), np.float32)
        out[:] = self.c
        active = np.searchsorted(-size, -np.arange(1, t_n + 1), side="right")
        full = int(active[-1])
        cols = np.arange(b_n)
        half = np.repeat(np.array([[0.5], [1.0]], np.float32), [2 * h_n, h_n], 0)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        for d in (0, 1):
            w, u, v = self.w[d] * half, self.u[d] * half, self.v[d]
            h = np.zeros((h_n, b_n), np.float32)
            for t in range(t_n):
                k = active[t]
                if k < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :k])
                if d == 0:
                    a = np.take(w, x[t, :k], axis=1, mode="clip")
                elif full == k:
                    a = np.take(w, x[t_n - 1 - t, :k], axis=1, mode="clip")
                else:
                    at = size[:k] - 1 - t
                    a = np.take(w, x[at, cols[:k]], axis=1, mode="clip")
                g = u @ h
                a[: 2 * h_n] += g[: 2 * h_n]
                zr = np.tanh(a[: 2 * h_n], out=a[: 2 * h_n])
                zr += 1
                zr *= 0.5
                n, g = a[2 * h_n :], g[2 * h_n :]
                g *= zr[h_n:]
                n += g
                np.tanh(n, out=n)
                h -= n
                h *= zr[:h_n]
                h += n
                y = v @ h
                if d == 0:
                    out[t, :, :k] += y
                elif full == k:
                    out[t_n - 1 - t, :, :k] += y
                else:
                    out[t_n - 1 - t, :, :full] += y[:, :full]
                    out[at[full:], :, cols[full:k]] += y[:, full:].T
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def documents(self, texts: list[str | None], block: int = 4096) -> np.ndarray:
        """(n, C) mean of the position probabilities over all bytes of each text; zeros for a text without any."""
        raw = [(t or "").encode() for t in texts]
        n = np.array([len(r) for r in raw], np.int64)
        base = np.concatenate([[0], np.cumsum(n)])
        buf = np.frombuffer(b"".join(raw) + b"\0" * WINDOW, np.uint8)
        per = -(-n // WINDOW)
        doc = np.repeat(np.arange(len(raw)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = base[doc] + nth * WINDOW
        size = np.minimum(WINDOW, n[doc] - nth * WINDOW)
        order = np.argsort(-size, kind="stable")
        total = np.zeros((len(raw), len(self.langs)))
        for i in range(0, len(order), block):
            o = order[i : i + block]
            s, length = size[o], int(size[o[0]])
            x = buf[start[o][None, :] + np.arange(length)[:, None]]
            p = self.positions(x, s)
            if s[-1] < length:
                p *= (np.arange(length)[:, None] < s[None, :])[:, None, :]
            pooled = p.sum(0)
            for c in range(len(self.langs)):
                total[:, c] += np.bincount(doc[o], pooled[c], len(raw))
        return total / np.maximum(n, 1)[:, None]


def train(samples: list[tuple[str, str]], hidden: int = 8, steps: int = 400, batch: int = 96, span: int = 64, seed: int = 7, rate: float = 0.02) -> Network:
    """Fits a :class:`Network` to (text, language) pairs: back-propagation through time over random windows, Adam.

    Every position of a window is trained on its document's language; languages are drawn equally often.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in samples})
    if not langs:
        raise ValueError("no labelled text to learn from")
    by = [[np.frombuffer(t.encode(), np.uint8) for t, lang in samples if lang == want and t] for want in langs]
    weight = [np.array([len(x) for x in xs], float) for xs in by]
    h_n, c_n = hidden, len(langs)
    shapes = [(3 * h_n, 256), (3 * h_n, h_n), (c_n, h_n)] * 2 + [(c_n, 1)]
    p = [rng.normal(0, 0.3 if s[1] == 256 else s[1] ** -0.5, s) for s in shapes]
    p[6][:] = 0
    m1, m2 = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, steps + 1):
        y = rng.integers(0, c_n, batch)
        x = np.zeros((span, batch), np.uint8)
        mask = np.zeros((span, batch))
        for b, k in enumerate(y):
            doc = by[k][rng.choice(len(by[k]), p=weight[k] / weight[k].sum())]
            at = rng.integers(0, max(1, len(doc) - span + 1))
            piece = doc[at : at + span]
            x[: len(piece), b], mask[: len(piece), b] = piece, 1
        grads = [np.zeros(s) for s in shapes]
        logits = np.zeros((span, c_n, batch)) + p[6]
        tapes = []
        for d in (0, 1):
            w, u, v = p[3 * d : 3 * d + 3]
            h, tape = np.zeros((h_n, batch)), {}
            for t in range(span) if d == 0 else range(span - 1, -1, -1):
                new, z, r, n, g = _cell(w[:, x[t]], u, h)
                live = mask[t]
                new = new * live + h * (1 - live)  # padding leaves the state alone
                tape[t] = (h, z, r, n, g, new)
                logits[t] += v @ new
                h = new
            tapes.append(tape)
        e = np.exp(logits - logits.max(1, keepdims=True))
        dl = e / e.sum(1, keepdims=True)
        dl[:, y, np.arange(batch)] -= 1
        dl *= (mask / mask.sum())[:, None, :]
        grads[6] += dl.sum((0, 2))[:, None]
        for d in (0, 1):
            w, u, v = p[3 * d : 3 * d + 3]
            dh = np.zeros((h_n, batch))
            for t in range(span - 1, -1, -1) if d == 0 else range(span):
                h, z, r, n, g, new = tapes[d][t]
                grads[3 * d + 2] += dl[t] @ new.T
                total = dh + v.T @ dl[t]
                dnew = total * mask[t]
                dan = dnew * (1 - z) * (1 - n * n)
                daz = dnew * (h - n) * z * (1 - z)
                dar = dan * g[2 * h_n :] * r * (1 - r)
                dg = np.concatenate([daz, dar, dan * r])
                dh = total * (1 - mask[t]) + dnew * z + u.T @ dg
                grads[3 * d + 1] += dg @ h.T
                np.add.at(grads[3 * d].T, x[t], np.concatenate([daz, dar, dan]).T)
        norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(grads):
            g /= norm
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            p[i] -= lr * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    q = [np.ascontiguousarray(a, np.float32) for a in p]
    return Network(langs, [q[0], q[3]], [q[1], q[4]], [q[2], q[5]], q[6])


def labelled_sample(docs: DataFrame, per_lang: int, doc_id: str, text: str, lang: str, chars: int) -> list[tuple[str, str]]:
    """At most about ``per_lang`` labelled texts of each language, chosen by the hash of the id; of each at most ``chars`` characters from any place."""
    counts = {r[0]: r[1] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    if not counts:
        return []
    room = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * per_lang / n))))
    unit = F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    place = 1 + F.pmod(F.xxhash64(F.col(doc_id), F.lit(13)), F.greatest(F.length(text) - chars + 1, F.lit(1))).cast("int")
    picked = known.where(unit < room[F.col(lang)]).select(F.substring(F.col(text), place, F.lit(chars)), F.col(lang), unit.alias("u")).collect()
    out: list[tuple[str, str]] = []
    taken = dict.fromkeys(counts, 0)
    for t, k, _ in sorted(picked, key=lambda r: (r[2], r[1], r[0])):
        if taken[k] < per_lang:
            taken[k] += 1
            out.append((t, k))
    return out


def fit(docs: DataFrame, per_lang: int = 300, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = 4000, **how) -> Network | None:
    """A network trained on a bounded sample (``per_lang`` texts a language, of each ``chars`` characters in a row from a place drawn over all of it) of labelled rows."""
    sample = labelled_sample(docs, per_lang, doc_id, text, lang, chars)
    return train(sample, **how) if sample else None


def _score(docs: DataFrame, net: Network | None, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the language and its probability, and the names of the two columns."""
    at = docs.columns.index(text)
    found, prob_name = free(docs, "found_lang"), free(docs, "found_prob")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            texts = b.column(at).to_pylist()
            best: list = [None] * len(texts)
            prob = np.zeros(len(texts))
            if shared.value is not None:
                p = shared.value.documents(texts)
                prob = p.max(1, initial=0)
                best = [shared.value.langs[k] if q > 0 else None for k, q in zip(p.argmax(1), prob, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(prob, pa.float64())], [*b.schema.names, found, prob_name])

    from pyspark.sql import types as T

    return texts_to_python(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, T.StringType()), T.StructField(prob_name, T.DoubleType())])), found, prob_name


def identify(docs: DataFrame, net: Network | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """(doc_id, lang, lang_prob, keep) of every row: the language with the highest pooled probability.

    Each byte of the whole text gets a probability for each language; a document's are the mean over its bytes.
    ``keep`` is whether the highest is at least ``least``. A null or empty text has a null language, probability 0 and
    keep false. Ties go to the first language in alphabetical order; repeated rows give one row each; other columns are
    ignored. Without a network one is fitted to ``docs``; where no row is labelled, every language is null.
    """
    net = net if net is not None else fit(docs, doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored, found, prob = _score(rows, net, "text")
    return scored.select("doc_id", F.col(found).alias("lang"), F.round(prob, 6).alias("lang_prob"), (F.col(prob) >= least).alias("keep"))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects, the found language in ``lang``; the columns stay."""
    net = fit(docs, doc_id=doc_id, text=text, lang=lang)
    scored, found, prob = _score(docs, net, text)
    return scored.where(F.col(prob) >= least).select(*(F.col(found).alias(lang) if c == lang else F.col(c) for c in docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
