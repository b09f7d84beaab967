"""Language identification with a bidirectional gated recurrent network.

The network reads the bytes of a text: one gated recurrent layer forward and
one backward, whose joined states give a probability of every language at
every byte. A document's probabilities are the mean over all its positions.
Long texts are read in segments of ``SEGMENT`` bytes with ``CONTEXT`` bytes
of lead-in on either side, so every byte of the whole text is labelled once
and thousands of segments advance together in one matrix product.

Gates use the piecewise linear sigmoid and tanh. Training is plain numpy:
backpropagation through time with Adam on a bounded sample of labelled
documents (``SAMPLE_DOCS`` per language; ``SAMPLE_ALL`` in all, shared evenly
among many languages; one segment each, chosen by hash). The states grow with
the square root of the number of languages. The weights (about 20 kB for a few
languages) travel in the task closure.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.
Rows of one text get one answer, whatever their other columns. Null labels
aren't learned from; without any label everything is ``und``. Every labelled
language is learned; a label set of more than ``MAX_LANGS`` raises. Columns
other than the text and, in training, the label and the id (for the draw) are
never read; all stay, and an own column whose name is taken gets a numbered
one. Rows that share an id or have none are drawn one by one, equal rows up to
the same bound. A text of any length is read whole, in segments. Languages of
equal probability: the first in byte order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import fresh, ship

SEGMENT, CONTEXT = 224, 16
HIDDEN = 8
#: bounds of the labelled sample: documents per language and in all, and the least share of a language
SAMPLE_DOCS, SAMPLE_ALL, LEAST_DOCS = 800, 51_200, 50
#: a larger label set is refused
MAX_LANGS = 1024
EPOCHS, BATCH, RATE = 10, 64, 0.02
LANES = 2048
UNKNOWN = "und"


class Network:
    """Weights by name; direction 0 reads forward, 1 backward."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, self.langs = hidden, langs
        self.w = {
            "E": rng.normal(0, 0.5, (2, 256, 3 * h)),  # input weights per byte, biases included
            "U": rng.normal(0, 0.4 / np.sqrt(h), (2, 2 * h, h)),  # update and reset gates
            "V": rng.normal(0, 0.4 / np.sqrt(h), (2, h, h)),  # candidate
            "O": rng.normal(0, 0.3, (len(langs), 2 * h)),
            "b": np.zeros((len(langs), 1)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @property
    def hidden(self) -> int:
        return self.w["V"].shape[1]

    def states(self, data: np.ndarray, keep: bool = False):
        """States of both directions at every position. ``data``: bytes as
        (time, lanes); 0 is padding before or after a text. Returns an array
        (time, 2 directions, hidden, lanes), and with ``keep`` the gates."""
        steps, lanes = data.shape
        h = self.hidden
        out = np.empty((steps, 2, h, lanes), np.float32)
        state = np.zeros((2, h, lanes), np.float32)
        table, U, V = self.w["E"], self.w["U"], self.w["V"]
        kept = []
        x = np.empty((2, lanes, 3 * h), np.float32)
        gates = np.empty((2, 2 * h, lanes), np.float32)
        cand = np.empty((2, h, lanes), np.float32)
        for t in range(steps):
            np.take(table[0], data[t], axis=0, out=x[0], mode="clip")
            np.take(table[1], data[steps - 1 - t], axis=0, out=x[1], mode="clip")
            xt = x.transpose(0, 2, 1)
            np.matmul(U, state, out=gates)
            gates += xt[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            if keep:
                raw = gates.copy()
            np.minimum(gates, 1.0, out=gates)
            np.maximum(gates, 0.0, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            r *= state
            np.matmul(V, r, out=cand)
            cand += xt[:, 2 * h :]
            if keep:
                raw_c, before = cand.copy(), state.copy()
            np.minimum(cand, 1.0, out=cand)
            np.maximum(cand, -1.0, out=cand)
            if keep:
                kept.append((raw, raw_c, before, z.copy(), r.copy(), cand.copy()))
            cand -= state
            cand *= z
            state += cand
            out[t, 0] = state[0]
            out[steps - 1 - t, 1] = state[1]
        return (out, kept) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(time, languages, lanes) from the joined states."""
        steps, _, h, lanes = states.shape
        p = np.matmul(self.w["O"], states.reshape(steps, 2 * h, lanes))
        p += self.w["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, data: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the masked positions and its gradients,
        by backpropagation through time."""
        steps, lanes = data.shape
        h = self.hidden
        states, kept = self.states(data, keep=True)
        p = self.probabilities(states)
        hot = np.eye(len(self.langs), dtype=np.float32)[target].T
        share = (mask / mask.sum()).astype(np.float32)
        loss = float(-(np.log(np.maximum((p * hot).sum(axis=1), 1e-9)) * share).sum())
        d = (p - hot) * share[:, None, :]
        flat = states.reshape(steps, 2 * h, lanes)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["O"] = np.einsum("tcn,thn->ch", d, flat)
        g["b"] = d.sum(axis=(0, 2))[:, None]
        back = np.matmul(self.w["O"].T, d).reshape(steps, 2, h, lanes)
        U, V = self.w["U"], self.w["V"]
        carry = np.zeros((2, h, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            raw, raw_c, before, z, rs, cand = kept[t]
            carry = carry + np.stack([back[t, 0], back[steps - 1 - t, 1]])
            dz = carry * (cand - before)
            dc = carry * z * (np.abs(raw_c) < 1)
            drs = np.matmul(V.transpose(0, 2, 1), dc)
            dr = drs * before
            inside = ((raw > 0) & (raw < 1)) * np.float32(0.25)
            da = np.concatenate([dz, dr], axis=1) * inside
            g["V"] += np.matmul(dc, rs.transpose(0, 2, 1))
            g["U"] += np.matmul(da, before.transpose(0, 2, 1))
            r = np.clip(raw[:, h:], 0, 1)
            dx = np.concatenate([da, dc], axis=1).transpose(0, 2, 1)
            np.add.at(g["E"][0], data[t], dx[0])
            np.add.at(g["E"][1], data[steps - 1 - t], dx[1])
            carry = carry * (1 - z) + drs * r + np.matmul(U.transpose(0, 2, 1), da)
        return loss, g

    def fit(self, data: np.ndarray, target: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; returns the loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(data.shape[1]), []
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                loss, g = self.gradients(data[:, pick], target[pick], mask[:, pick])
                total.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.9 * epoch / max(1, epochs))
                for k in self.w:
                    x = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(float(np.mean(total)))
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, languages); zeros for empty texts."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pad = CONTEXT + SEGMENT + CONTEXT
        # all texts in one buffer, each followed by padding
        begin = np.concatenate([[0], np.cumsum(sizes + pad)]) + pad
        flat = np.zeros(int(begin[-1]) + pad, np.uint8)
        for t, b in zip(texts, begin):
            flat[b : b + len(t)] = np.frombuffer(t, np.uint8)
        count = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[doc] + nth * SEGMENT
        size = np.minimum(sizes[doc] - nth * SEGMENT, SEGMENT)
        order = np.argsort(size, kind="stable")  # short segments together, so little is padded
        lanes = LANES * 64 // max(64, len(self.langs))  # many languages: fewer segments together
        for at in range(0, len(order), lanes):
            pick = order[at : at + lanes]
            longest = int(size[pick].max())
            span = np.arange(-CONTEXT, longest + CONTEXT)
            data = flat[start[pick][None, :] + span[:, None]]
            p = self.probabilities(self.states(data)[CONTEXT : CONTEXT + longest])
            if size[pick[0]] < longest:
                p *= (np.arange(longest)[:, None] < size[pick][None, :])[:, None, :]
            np.add.at(total, doc[pick], p.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def segment_at(size: int, pick: int) -> int:
    """Start of the training segment of a text."""
    return 0 if size <= SEGMENT else pick % (size - SEGMENT + 1)


def hidden_for(langs: int) -> int:
    """States per direction that tell so many languages apart."""
    return max(HIDDEN, int(np.ceil(2 * np.sqrt(langs))))


def fit(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Train on at most ``sample_docs`` documents per language, fewer if all
    languages together would exceed ``SAMPLE_ALL``: of the labelled rows where
    ``usable`` holds, those with the smallest hash."""
    rows = docs.where(usable) if usable is not None else docs
    rows = rows.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    counts = rows.groupBy(F.col(f"`{lang}`").alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if not counts:
        return None
    if len(counts) > MAX_LANGS:
        raise ValueError(f"column {lang} has more than {MAX_LANGS} labels, too many for the language network")
    sample_docs = min(sample_docs, max(LEAST_DOCS, SAMPLE_ALL // len(counts)))
    langs = sorted(r["lang"] for r in counts)
    most = {r["lang"]: r["count"] for r in counts}
    # by id and text: rows that share an id, or have none, are drawn one by one
    rank = F.pmod(F.xxhash64(F.lit("langid"), f"`{key}`", f"`{text}`"), F.lit(1 << 40))
    size = F.octet_length(f"`{text}`")
    start = F.when(size <= SEGMENT, 0).otherwise(F.pmod(F.xxhash64(F.lit("segment"), f"`{key}`", f"`{text}`"), size - SEGMENT + 1)).cast("int")

    def draw(of: DataFrame) -> pd.DataFrame:
        """The first ``sample_docs`` rows of each language, by hash; each task sends no more than that."""
        cut = of.select(F.col(f"`{lang}`").alias("lang"), rank.alias("rank"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"), start.alias("at"))
        cut = cut.selectExpr("lang", "rank", "substring(raw, at + 1, %d) AS raw" % SEGMENT)
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "raw"))
        return cut.withColumn("nth", nth).where(F.col("nth") <= sample_docs).toPandas()

    # a threshold on a uniform hash leaves about 1.5 times the wanted rows of each language
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 40, int(1.5 * sample_docs / most[k] * (1 << 40)) + 1))])
    chosen = draw(rows.where(rank < limit[F.col(f"`{lang}`")]))
    got = chosen["lang"].value_counts()
    short = [k for k in langs if got.get(k, 0) < min(sample_docs, most[k])]
    if short:  # many equal rows: their common hash lies beyond the threshold
        chosen = pd.concat([chosen[~chosen["lang"].isin(short)], draw(rows.where(F.col(f"`{lang}`").isin(short)))])
    if chosen.empty:
        raise RuntimeError("no labelled row could be drawn")
    chosen = chosen.sort_values(["lang", "rank", "raw"], kind="stable")
    net = Network(langs, hidden_for(len(langs)))
    data = np.zeros((SEGMENT + 2 * CONTEXT, len(chosen)), np.uint8)
    for k, raw in enumerate(chosen["raw"]):
        data[CONTEXT : CONTEXT + len(raw), k] = np.frombuffer(bytes(raw), np.uint8)
    mask = np.zeros(data.shape, np.float32)
    mask[data > 0] = 1.0
    target = chosen["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    net.fit(data, target, mask)
    return net


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` and ``score`` (the pooled probability)."""
    ship(docs.sparkSession)
    s = fresh(docs.columns, "__lang")

    @F.pandas_udf("struct<lang:string,score:double>")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        most = 4_000_000 // len(net.langs) if net else 4_000_000  # texts whose probabilities are kept together
        for texts in parts:
            langs, scores = [], []
            raws = [(t or "").encode() for t in texts]
            at = 0
            while at < len(raws):  # bounded memory: a few megabytes of text at a time
                stop, size = at, 0
                while stop < len(raws) and (stop == at or size + len(raws[stop]) <= 2_000_000 and stop - at < most):
                    size += len(raws[stop])
                    stop += 1
                p = net.documents(raws[at:stop]) if net else np.zeros((stop - at, 1))
                best = p.argmax(axis=1)
                langs += [net.langs[b] if net else UNKNOWN for b in best]
                scores += p.max(axis=1).tolist()
                at = stop
            yield pd.DataFrame({"lang": langs, "score": scores})

    readable = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    names = docs.columns
    return docs.withColumn(s, label(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in names],
        F.when(readable, F.col(f"`{s}`.lang")).otherwise(F.lit(UNKNOWN)).alias(fresh(names, "lang_pred")),
        F.when(readable, F.least(F.col(f"`{s}`.score"), F.lit(1.0))).otherwise(F.lit(0.0)).alias(fresh(names, "score")),
    )


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
