"""Language-model scoring: a log-bilinear model trained in numpy with
noise-contrastive estimation.

Tokens are the words of a text (blanks \\x20 \\x09-\\x0D, A-Z lower-cased) and
one end. The predicted vocabulary is the ``SHORT`` most frequent training
tokens (the end always among them) and one tail class; a tail word's share of
its class is its add-one unigram share, so probabilities sum to one over all
training tokens and one unknown. The context is the two tokens before:
score(w | h) = (C1 * Q[h1] + C2 * Q[h2]) . R[w] + b[w], as in the log-bilinear
model with diagonal context matrices.

Training runs where the data lies: every partition makes one pass over all
its training texts from a common start, with noise drawn from the unigram
distribution and AdaGrad steps, and the parameters are averaged by tokens in
a combined aggregate. Counts cover all training texts. Normalisers are exact:
batched matrix products over all pairs of context tokens, computed once as a
Spark job and broadcast (a fixed (SHORT + 3) squared table). Counts of words
outside the ``TOP`` most frequent ones are joined by shuffle, summed per text
first.

Null texts count as empty: their only token is the end. Null ids are learned
from; equal ids and repeated rows are scored each. Without training texts
every count is 0 and the model is the base. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub, quiet_threads

SHORT = 511
TOP = 50_000
DIM = 16
NOISE = 16
BATCH = 1024
RATE = 0.2
END = b""  # no word is empty
HELD = 400_000  # words counted in a task before they are sent on


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches):
    c = Counter()

    def out():
        w, n = list(c), list(c.values())
        c.clear()
        for i in range(0, len(w), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(w[i:i + 50_000], pa.binary()), pa.array(n[i:i + 50_000], pa.int64())], names=["w", "n"])
    for batch in batches:
        for t in batch.column(0).to_pylist():
            c.update(words(t))
            c[END] += 1
            if len(c) > HELD:
                yield from out()
    yield from out()


def count_words(texts: DataFrame) -> DataFrame:
    """(w binary, c): counts of all tokens of a binary text column ``t``."""
    return texts.select("t").mapInArrow(_count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The TOP most frequent tokens by index, their counts, N and V."""

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int):
        self.index = {w: i for i, (w, _) in enumerate(top)}
        self.count = np.array([c for _, c in top] + [0], float)
        self.n, self.v = n, v
        self.short = min(SHORT, len(top))
        self.tail, self.bos = self.short, self.short + 1
        self.size = self.short + 2  # short words, tail, start
        self.base_mass = n + v + 1
        self.tail_mass = self.base_mass - float((self.count[:self.short] + 1).sum())

    def noise(self) -> np.ndarray:
        p = np.append(self.count[:self.short] + 1, max(self.tail_mass, 1.0))
        return p / p.sum()


def start(v: Vocabulary, seed: int = 7) -> list[np.ndarray]:
    """Q, R, C, b: the unigram model plus small noise."""
    g = np.random.default_rng(seed)
    small = lambda *s: (g.standard_normal(s) * 0.1).astype(np.float32)
    return [small(v.size, DIM), small(v.short + 1, DIM), np.ones((2, DIM), np.float32) * 0.5, np.log(v.noise()).astype(np.float32)]


def _add_rows(shape, rows, values):
    """Sums of ``values`` by row index."""
    out = np.zeros(shape, np.float32)
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    out[r[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive AdaGrad steps on (h1, h2, w) index triples."""

    def __init__(self, v: Vocabulary, seed: int):
        self.p = start(v)
        self.g = [np.full_like(x, 1e-3) for x in self.p]
        self.rng = np.random.default_rng(seed)
        noise = v.noise()
        self.cum, self.log_kn = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)

    def step(self, h1, h2, w):
        q, r, c, b = self.p
        a1, a2 = q[h1], q[h2]
        ctx = c[0] * a1 + c[1] * a2
        rw = r[w]
        z = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(b) - 1)
        rz = r[z]
        # d = P(data | token) - label, for the target and the shared noise.
        d_w = 1 / (1 + np.exp(-((ctx * rw).sum(1) + b[w] - self.log_kn[w]))) - 1
        d_z = 1 / (1 + np.exp(-(ctx @ rz.T + b[z] - self.log_kn[z])))
        g_ctx = d_w[:, None] * rw + d_z @ rz
        g_r = _add_rows(r.shape, w, d_w[:, None] * ctx)
        np.add.at(g_r, z, d_z.T @ ctx)
        g_b = np.bincount(w, d_w, len(b)).astype(np.float32)
        np.add.at(g_b, z, d_z.sum(0))
        g_q = _add_rows(q.shape, np.concatenate([h1, h2]), np.concatenate([g_ctx * c[0], g_ctx * c[1]]))
        g_c = np.stack([(g_ctx * a1).sum(0), (g_ctx * a2).sum(0)])
        for x, s, g in zip(self.p, self.g, (g_q, g_r, g_c, g_b)):
            g /= len(w)
            s += g * g
            x -= RATE * g / np.sqrt(s)


def triples(docs: list[np.ndarray], v: Vocabulary):
    """(h1, h2, w) of texts given as arrays of predicted classes with the
    end; the start stands for what is before the first token."""
    pad = np.array([v.bos, v.bos])
    flat = np.concatenate([x for d in docs for x in (pad, d)])
    own = np.ones(len(flat), bool)
    at = np.cumsum([0] + [len(d) + 2 for d in docs[:-1]])
    own[at] = own[at + 1] = False
    i = np.flatnonzero(own)
    return flat[i - 1], flat[i - 2], flat[i]


def _train(shared):
    def run(batches):
        quiet_threads()
        from pyspark import TaskContext
        v = shared.value
        t, seen, held, size = Trainer(v, TaskContext.get().partitionId()), 0, [], 0
        end, get = v.index.get(END, v.tail), v.index.get

        def learn():
            nonlocal seen
            h1, h2, w = triples(held, v)
            order = t.rng.permutation(len(w))
            for i in range(0, len(w), BATCH):
                o = order[i:i + BATCH]
                t.step(h1[o], h2[o], w[o])
            seen += len(w)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([get(x, v.tail) for x in words(text)] + [end])
                held.append(np.minimum(ids, v.tail))
                size += len(ids)
                if size > 1 << 17:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if seen:
            flat = np.concatenate([x.ravel() for x in t.p]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat])], names=["n", "p"])
    return run


class Model:
    """Averaged parameters and the log normalisers of all contexts."""

    def __init__(self, v: Vocabulary, params: list[np.ndarray], log_z: np.ndarray | None = None):
        self.q, self.r, self.c, self.b = params
        self.v, self.log_z = v, log_z

    def normalisers(self, h1: int) -> np.ndarray:
        """log Z of the contexts (h1, every token)."""
        s = (self.c[0] * self.q[h1] + self.c[1] * self.q) @ self.r.T + self.b
        top = s.max(1)
        return top + np.log(np.exp(s - top[:, None]).sum(1))

    def log10(self, h1, h2, w) -> np.ndarray:
        ctx = self.c[0] * self.q[h1] + self.c[1] * self.q[h2]
        return ((ctx * self.r[w]).sum(1) + self.b[w] - self.log_z[h1, h2]).astype(float) / np.log(10)


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The end and at most TOP words, the most frequent ones: a histogram of
    counts (some 64 bins a factor of two) gives the count from which on the
    words are few enough, so no sort and no more than TOP rows are needed."""
    step = F.floor(F.log2("c") * 64)
    bins = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, least = TOP, None
    for s, n in bins:
        room -= n
        if room < 0:
            break
        least = s
    kept = F.lit(False) if least is None else step >= least
    rows = counts.filter(kept | (F.col("w") == F.lit(END))).collect()
    return sorted(((bytes(r["w"]), r["c"]) for r in rows), key=lambda x: (x[0] != END, -x[1], x[0]))


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """Fit on a binary text column ``t`` and its token counts."""
    spark = texts.sparkSession
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    v = Vocabulary(frequent(counts), total["n"] or 0, total["v"])
    shared = spark.sparkContext.broadcast(v)
    parts = texts.select("t").mapInArrow(_train(shared), "n long, p array<double>")
    mean = (parts.select("n", F.posexplode("p").alias("i", "x")).groupBy("i")
            .agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).orderBy("i").collect())
    params = start(v)
    if mean:  # a fixed number of parameters, whatever the data
        flat, at = np.array([r["x"] for r in mean], np.float32), 0
        for k, x in enumerate(params):
            params[k] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
    model = Model(v, params)
    whole = spark.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            i = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([whole.value.normalisers(x).astype(float) for x in i], pa.list_(pa.float64()))], names=["id", "z"])
    table = spark.range(v.size).mapInArrow(rows, "id long, z array<double>").collect()
    model.log_z = np.array([r["z"] for r in sorted(table, key=lambda r: r["id"])], np.float32)
    return model


SCORED = "doc_id {id}, held_out boolean, rid long, n_tokens long, n_known long, base double, lm double, w array<binary>, n array<int>"


def _score(shared):
    def run(batches):
        quiet_threads()
        from pyspark import TaskContext
        m = shared.value
        v, get, top = m.v, m.v.index.get, len(m.v.index)
        end = get(END, top)
        log_c = np.log10(v.count + 1)
        tail = np.log10(max(v.tail_mass, 1.0))
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, held, texts = (batch.column(i) for i in range(3))
            texts = texts.to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and b - a < 256 and (b == a or size < 1_000_000):
                    size += len(texts[b] or b"")
                    b += 1
                ids, rare = [], []
                for t in texts[a:b]:
                    ws = words(t)
                    i = np.array([get(x, top) for x in ws] + [end])
                    ids.append(i)
                    rare.append(Counter([ws[k] for k in np.flatnonzero(i[:-1] == top)]))
                flat = np.concatenate(ids)
                lens = np.array([len(i) for i in ids])
                cls = [np.minimum(i, v.tail) for i in ids]
                lp = m.log10(*triples(cls, v))
                lc = log_c[flat]
                known = (flat < top) & (v.count[flat] > 0)
                # Tail words of known count; the others follow from the join.
                lp += np.where((flat >= v.short) & (flat < top), lc - tail, 0) - np.where(flat == top, tail, 0)
                cut = np.concatenate(([0], np.cumsum(lens)[:-1]))
                yield pa.RecordBatch.from_arrays([
                    keys[a:b], held[a:b], pa.array(rid + np.arange(b - a)), pa.array(lens.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), cut)),
                    pa.array(np.add.reduceat(lc, cut)), pa.array(np.add.reduceat(lp, cut)),
                    pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32()))],
                    names=["doc_id", "held_out", "rid", "n_tokens", "n_known", "base", "lm", "w", "n"])
                rid += b - a
                a = b
    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score);
    the model learns from the rows where the column ``held_out`` is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    learned = rows.filter("not held_out")
    counts = hub(count_words(learned))
    model = train(learned, counts)
    v, shared = model.v, spark.sparkContext.broadcast(model)
    part = hub(rows.mapInArrow(_score(shared), SCORED.format(id=dict(rows.dtypes)["doc_id"])))
    rare = (part.select("rid", F.explode(F.arrays_zip("w", "n")).alias("x")).select("rid", "x.w", "x.n")
            .join(counts, "w", "left")
            .select("rid", F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("s"))
            .groupBy("rid").agg(F.sum("n_known").alias("rare_known"), F.sum("s").alias("s")))
    s, known = F.coalesce("s", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return part.drop("w", "n").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * F.log10(F.lit(float(v.base_mass)))).alias("base_score"), (F.col("lm") + s).alias("score"))
