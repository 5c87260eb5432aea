"""Toxicity (operator 4): a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word enters as an embedding of its hash beside the mean embedding of its character n-grams. The network is trained in
numpy on the driver from at most FIT_ROWS labelled texts outside the held-out fold, a third of them toxic at most, and scores
all windows of SPAN words, each STRIDE words (half a window) after the last, of every whole text; a text's score is its highest window's.
These texts are trained on whole. Should they hold more than FIT_BYTES together, tasks draw the same share of runs of SPAN words of every one of them
by hash, so that what reaches the driver is bounded; runs of over RUN_BYTES, of words no language has, are then never drawn.
As only whole texts have labels, training takes the windows that score highest so far, of toxic and of clean texts alike.
The last bias is then moved by the log odds between the sample's share of toxic texts and that of all labels.

Defined results: a text without words, or null, scores 0. Repeated rows get equal scores, one row each. Without labels of both
classes every score is 0. Null doc_id counts as not held out. A labelled doc_id with several texts is trained on by the least of them. An empty table gives an empty result. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample, texts_of
from .shared import pieces, released, slices, text_bytes
from .words import Words, mix

FIT_ROWS, THRESHOLD = 4_500, 0.7
SPAN, STRIDE = 64, 32
FIT_BYTES, RUN_BYTES = 32 << 20, 1 << 16
WORDS, CHARS, E, H, A = 1 << 18, 1 << 16, 8, 8, 8
f32 = np.float32


class Vocabulary:
    """The distinct words of some texts: bucket of each, bucket lists of their n-grams, and each word's place in the list."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, lower=True)
        hashes, one, self.at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.first, self.counts = w.first, w.counts
        self.hashes, self.word = hashes, (hashes % WORDS).astype(np.int64)
        starts, ends = w.starts[one], w.ends[one]
        grams, owner = [], []
        for n in (3, 4):
            k = np.maximum(ends - starts - n + 1, (n == 3) * 1)  # a shorter word is one gram
            own = np.repeat(np.arange(len(k)), k)
            s = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
            grams.append((w.spans.hash(s, np.minimum(s + n, ends[own])) % CHARS).astype(np.int64))
            owner.append(own)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = np.concatenate(grams)[order], owner[order]
        self.sizes = np.bincount(owner, minlength=len(one))
        self.begin = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def joined(cls, data: np.ndarray, offsets: np.ndarray) -> "Vocabulary":
        """The same for many texts, made from slices of them, of which only new words are kept: the arrays over all bytes would be large."""
        out, known, names = cls.__new__(cls), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        word, sizes, grams, at, counts = [known.astype(np.int64)], [names], [names], [names], [np.zeros(0, np.int64)]
        for i, j in slices(offsets):
            v = cls(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            place = np.searchsorted(known, v.hashes)
            new = np.ones(len(place), bool)
            new[place < len(known)] = known[place[place < len(known)]] != v.hashes[place < len(known)]
            name = np.empty(len(place), np.int32)
            name[~new], name[new] = names[place[~new]], len(known) + np.arange(new.sum())
            added = Subset(v, np.flatnonzero(new))
            word.append(added.word), sizes.append(added.sizes), grams.append(added.grams.astype(np.int32)), at.append(name[v.at]), counts.append(v.counts)
            known, names = np.insert(known, place[new], v.hashes[new]), np.insert(names, place[new], name[new])
        rank = np.empty(len(known), np.int32)
        rank[names] = np.arange(len(known))
        out.hashes, out.counts, out.at = known, np.concatenate(counts), rank[np.concatenate(at)]
        out.first = np.append(0, np.cumsum(out.counts))
        every, flat = np.concatenate(sizes), np.concatenate(grams)
        out.word, out.sizes = np.concatenate(word)[names], every[names]
        out.begin, begin = np.cumsum(out.sizes) - out.sizes, (np.cumsum(every) - every)[names]
        out.owner = np.repeat(np.arange(len(known), dtype=np.int32), out.sizes)
        out.grams = flat[begin[out.owner] + np.arange(len(out.owner)) - out.begin[out.owner]]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of each window, and its words as places in the list; beyond the text, the list's length."""
        n = np.where(self.counts > 0, 1 + np.ceil(np.maximum(self.counts - SPAN, 0) / STRIDE).astype(np.int64), 0)
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = (self.first[doc] + STRIDE * k)[:, None] + np.arange(SPAN)
        inside = at < self.first[doc + 1][:, None]
        return doc, np.where(inside, self.at[np.minimum(at, max(len(self.at) - 1, 0))] if len(self.at) else 0, len(self.word))


def squash(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


class ToxicNet:
    def __init__(self, seed: int = 7):
        r = np.random.RandomState(seed)
        n = lambda *s, k=0.3: (r.randn(*s) * k).astype(f32)
        self.p = {"words": n(WORDS, E, k=0.1), "chars": n(CHARS, E, k=0.3), "out": n(2 * H), "bias": np.zeros(1, f32), "att": n(2 * H, A), "att_b": np.zeros(A, f32), "att_v": n(A)}
        for d in "fb":
            self.p |= {f"in_{d}": n(2 * E, 3 * H), f"in_b_{d}": np.zeros(3 * H, f32), f"rec_{d}": n(H, 3 * H)}
        self.trained = False

    def inputs(self, v: Vocabulary, words: np.ndarray | None = None) -> np.ndarray:
        sums = np.zeros((len(v.word), E), f32)
        for i in range(0, len(v.word), 1 << 15):
            a = v.begin[i : i + (1 << 15)]
            sums[i : i + (1 << 15)] = np.add.reduceat(self.p["chars"][v.grams[a[0] : a[-1] + v.sizes[i + len(a) - 1]]], a - a[0])
        return np.concatenate([self.p["words"][v.word], sums / np.maximum(v.sizes, 1).astype(f32)[:, None]], 1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The input part of all gates for each word; the last row, for places beyond the text, keeps the state."""
        out = {}
        for d in "fb":
            g = np.zeros((len(x) + 1, 3 * H), f32)
            g[:-1] = x @ self.p[f"in_{d}"] + self.p[f"in_b_{d}"]
            g[-1, :H] = 30
            out[d] = g
        return out

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; keep: gets what the backward pass needs."""
        inside = at < len(gates["f"]) - 1
        states = np.empty((SPAN, len(at), 2 * H), f32)
        for k, d in enumerate("fb"):
            h, u, saved = np.zeros((len(at), H), f32), self.p[f"rec_{d}"], []
            for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
                x, hu = gates[d][at[:, t]], h @ u
                zr = squash(x[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
                if keep is not None:
                    saved.append((t, h, z, r, n, hu[:, 2 * H :]))
                h = n + z * (h - n)
                states[t, :, k * H : (k + 1) * H] = h
            if keep is not None:
                keep.append(saved)
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.where(inside.T, a @ self.p["att_v"], f32(-1e9))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tw,twh->wh", e, states)
        if keep is not None:
            keep.append((states, a, e, pooled))
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, v: Vocabulary, at: np.ndarray, block: int = 2048) -> np.ndarray:
        gates = self.project(self.inputs(v))
        return np.concatenate([self.run(gates, at[i : i + block]) for i in range(0, len(at), block)] or [np.zeros(0, f32)])

    def gradients(self, v: Vocabulary, at: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the mean logistic loss: of the dense parameters, and of the inputs of the words in the batch."""
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        pad = used[-1] == len(v.word)
        words = used[:-1] if pad else used
        sub = Subset(v, words)
        x = self.inputs(sub)
        gates, keep = self.project(x), []
        logit = self.run(gates, local, keep)
        (states, a, e, pooled), g = keep.pop(), {}
        d = ((squash(logit) - y) / len(y)).astype(f32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], f32)
        dp = d[:, None] * self.p["out"]
        ds = e[:, :, None] * dp[None]
        de = np.einsum("twh,wh->tw", states, dp)
        de = e * (de - (e * de).sum(0))
        g["att_v"] = np.einsum("tw,twa->a", de, a)
        da = de[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("twh,twa->ha", states, da), da.sum((0, 1))
        ds += da @ self.p["att"].T
        dx = np.zeros_like(x)
        order = np.argsort(local.T.ravel(), kind="stable")
        first = np.searchsorted(local.T.ravel()[order], np.arange(len(used)))
        for k, way in enumerate("fb"):
            u, dh = self.p[f"rec_{way}"], np.zeros((len(at), H), f32)
            du, dsteps = np.zeros_like(u), np.empty((SPAN, len(at), 3 * H), f32)
            for t, h, z, r, n, hn in reversed(keep[k]):
                dh = dh + ds[t, :, k * H : (k + 1) * H]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                full = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ full
                dsteps[t, :, : 2 * H], dsteps[t, :, 2 * H :] = full[:, : 2 * H], dn
                dh = dh * z + full @ u.T
            dgates = np.add.reduceat(dsteps.reshape(-1, 3 * H)[order], first)[: len(words)]
            g[f"rec_{way}"], g[f"in_{way}"], g[f"in_b_{way}"] = du, x.T @ dgates, dgates.sum(0)
            dx += dgates @ self.p[f"in_{way}"].T
        return g, words, dx

    def fit(self, v: Vocabulary, doc: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> "ToxicNet":
        """doc: the text of each window; y: the label of each text."""
        r, moments, step = np.random.RandomState(seed), {}, 0
        for epoch in range(epochs):
            score = r.rand(len(at)) if epoch == 0 else self.logits(v, at) + 0.01 * r.rand(len(at))
            order = np.lexsort((-score, doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order], "left")
            chosen = order[rank < 2]
            if epoch:  # and one window of each clean text at random
                chosen = np.union1d(chosen, r.permutation(np.flatnonzero(y[doc] == 0))[: len(y)])
            chosen, batch = r.permutation(chosen), min(256, max(64, len(chosen) // 100))
            for i in range(0, len(chosen), batch):
                b = chosen[i : i + batch]
                g, words, dx = self.gradients(v, at[b], y[doc[b]].astype(f32))
                step += 1
                speed = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k, x in g.items():
                    m, s = moments.setdefault(k, [np.zeros_like(x), np.zeros_like(x)])
                    m += 0.1 * (x - m)
                    s += 0.001 * (x * x - s)
                    self.p[k] -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(f32)
                sub = Subset(v, words)
                for k, rows, x in (("words", sub.word, dx[:, :E]), ("chars", sub.grams, (dx[:, E:] / np.maximum(sub.sizes, 1)[:, None])[sub.owner])):
                    one, back = np.unique(rows, return_inverse=True)
                    order = np.argsort(back, kind="stable")
                    total = np.add.reduceat(x[order], np.searchsorted(back[order], np.arange(len(one))))
                    seen = moments.setdefault(k, np.zeros(len(self.p[k]), f32))
                    seen[one] += (total * total).mean(1)
                    self.p[k][one] -= f32(3 * speed) * total / (np.sqrt(seen[one])[:, None] + f32(1e-6))
        self.trained = True
        return self


class Subset:
    """A Vocabulary's arrays for some of its words."""

    def __init__(self, v: Vocabulary, words: np.ndarray):
        self.word, self.sizes = v.word[words], v.sizes[words]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.grams = v.grams[v.begin[words][self.owner] + np.arange(len(self.owner)) - self.begin[self.owner]] if len(words) else v.grams[:0]


def scores(net: ToxicNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest window's probability for each text."""
    out = np.zeros(len(offsets) - 1)
    if net.trained:
        v = Vocabulary(data, offsets)
        doc, at = v.windows()
        np.maximum.at(out, doc, squash(net.logits(v, at)).astype(float))
    return out


def drawn(share: float):
    """(doc_id, text, y) with that share of each text's runs of SPAN words, drawn by a hash of the run; runs of over RUN_BYTES never are."""
    top = np.uint64(int(share * ((1 << 64) - 1)))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                w, texts = Words(data, offsets), []
                hashes = w.hashes()
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    firsts = np.arange(a, b, SPAN)
                    lasts = np.minimum(firsts + SPAN, b) - 1
                    keep = (mix(hashes[firsts] + np.arange(len(firsts), dtype=np.uint64)) <= top) & (w.ends[lasts] - w.starts[firsts] <= RUN_BYTES)
                    texts.append(b" ".join(data[w.starts[i] : w.ends[j]].tobytes() for i, j in zip(firsts[keep].tolist(), lasts[keep].tolist(), strict=True)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), rows.column(2)], ["doc_id", "text", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> ToxicNet:
    """A network of labels.toxic from at most `rows` labelled texts of the training fold, or from runs of them of about most_bytes together."""
    chosen = sample(labels, "toxic", fold(3) != 1, rows, balanced=True)
    read = texts_of(docs, chosen)
    held = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > most_bytes:
        read = read.mapInArrow(released(drawn(most_bytes / held)), "doc_id long, text string, y int")
    found = read.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    y = found["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return ToxicNet()
    v = Vocabulary.joined(*text_bytes(pa.array(found["text"], pa.string())))
    net, odds = ToxicNet().fit(v, *v.windows(), y), lambda p: np.log(p / (1 - p))
    share = labels.filter(fold(3) != 1).agg(F.avg((F.col("toxic") >= 0.5).cast("double"))).first()[0]
    net.p["bias"] += f32(odds(share) - odds(y.mean()))
    return net


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; see the module's docstring."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))  # of fixed size

    def scored(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, most=1 << 21):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(net.value, data, offsets))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(scored), "doc_id long, score double")
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
