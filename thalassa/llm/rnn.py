"""A gated recurrent language model over whole documents: numpy, truncated backpropagation, class-factored softmax.

Tokens are words (A-Z as a-z) and one end per text. The VOCABULARY - most frequent training words and the end have
outputs of their own, in classes of CLASS words by frequency: P(word) = P(class | state) P(word | class, state). All
other words are dealt by hash to buckets with an input and an output each, in classes likewise; there are as many buckets
as the root of the number of words, so they grow with the corpus. A bucket's words share its output by their counts:
(c + 1) / (N' + V' + 1) over the words of the bucket. A text starts from a zero state with the end as input; the state
is carried across windows to its end.

Word counts are those of all training rows, summed in each task before they are shuffled; the counts of the FREQUENT
most frequent words (a fixed number) travel with the tasks, all other words of a text meet their counts in a join.
Training: every training text is seen once, in one of ROUNDS rounds by its hash. A task folds its texts into LANES lanes
of windows of WINDOW steps, state carried over, the last ones padded; each task trains from the same start, and after
each round the parameters are averaged by tokens.

Cases: a null or empty text has the end alone. A null doc_id trains and is not held out. Repeated rows are scored each,
and each counts. Without training rows the counts are 0 and the outputs uniform. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

VOCABULARY, CLASS, HIDDEN = 1024, 64, 16
FREQUENT = 1 << 17
FOLDS, HELD = 7, 2
ROUNDS = 2
WINDOW, LANES = 16, 768
SCORE_WINDOW = 32
#: Outputs wait for a window's end with so many: the last texts of a group are few, their windows small.
SCORE_ROWS = 1 << 14
#: Tokens that are scored together: long texts share their steps with as many others as may be.
SCORE_TOKENS = 1 << 20
_FLUSH = 1 << 22
#: Numbers of a block of the softmax, which stays in a core's cache.
_BLOCK = 1 << 15
_END = np.uint64(textnum.END)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes with an end after each text, bounds of the texts) per run of rows."""
    for _, data, offsets in textnum.slices(column):
        h, _, bounds = textnum.words(data, offsets)
        n = len(bounds) - 1
        out = np.insert(h, bounds[1:], _END)
        yield out, bounds + np.arange(n + 1)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and bounds of several runs of texts as one."""
    ends = np.cumsum([0] + [len(t) for t, _ in parts])
    return np.concatenate([t for t, _ in parts]), np.append(np.concatenate([b[:-1] + e for (_, b), e in zip(parts, ends)]), ends[-1])


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): the count of each token hash."""

    def run(batches):
        held, size = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"w": u.view(np.int64), "c": c.astype(np.int64)})

        for b in batches:
            for t, _ in tokens(b.column(0)):
                held.append(t)
                size += len(t)
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def buckets(distinct: int) -> int:
    """The number of buckets for the words outside the vocabulary, of `distinct` words in all."""
    return CLASS * max(1, -int(-(distinct**0.5) // CLASS))


def bucket(w: np.ndarray, n: int) -> np.ndarray:
    return ((w >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


class Counts:
    """The totals of all words, the counts of the most frequent ones, and by bucket the sum (tail_c) and number (tail_n) of all."""

    def __init__(self, w: np.ndarray, c: np.ndarray, tail_c: np.ndarray, tail_n: np.ndarray):
        self.buckets = len(tail_c)
        rank = np.argsort(-c, kind="stable")
        ends = np.flatnonzero(w[rank] == _END)
        if len(ends):  # the end always has an output
            rank = np.concatenate([rank[ends], np.delete(rank, ends)])
        vocabulary = rank[:VOCABULARY]
        order = np.argsort(w)
        self.w, self.c = w[order], c[order]
        place = VOCABULARY + bucket(w, self.buckets)
        place[vocabulary] = np.arange(len(vocabulary))
        self.place = place[order]
        own = bucket(w[vocabulary], self.buckets)
        self.mass = np.zeros(VOCABULARY + self.buckets)
        self.mass[: len(vocabulary)] = c[vocabulary]
        self.mass[VOCABULARY:] = tail_c - np.bincount(own, c[vocabulary], self.buckets)
        self.rest = self.mass[VOCABULARY:] + tail_n - np.bincount(own, minlength=self.buckets) + 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "first"}

    def _slots(self) -> tuple[np.uint64, np.ndarray]:
        """(bits that leave the slot of a hash, the first of each slot's words): two slots and more a word."""
        bits = (2 * len(self.w)).bit_length()
        shift = np.uint64(64 - bits)
        if not hasattr(self, "first"):
            self.first = np.searchsorted(self.w >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return shift, self.first

    def look(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, -1 if it must be joined; place: below VOCABULARY in the vocabulary, else that of the bucket)."""
        place = VOCABULARY + bucket(t, self.buckets)
        if not len(self.w):
            return np.full(len(t), -1), np.where(t == _END, 0, place).astype(np.int32)
        shift, first = self._slots()
        slot = (t >> shift).astype(np.int64)
        at, count = first[slot], np.full(len(t), -1)
        left = np.flatnonzero(at < first[slot + 1])
        while len(left):  # a slot's words one after the other
            here = at[left]
            hit = self.w[here] == t[left]
            found, here = left[hit], here[hit]
            count[found], place[found] = self.c[here], self.place[here]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < first[slot[left] + 1]]
        return count, place


class Gru:
    """Input table, recurrence, and the two layers of the factored softmax."""

    def __init__(self, mass: np.ndarray):
        """mass: the count of each place."""
        n = len(mass)
        self.classes = -(-n // CLASS)
        full = self.classes * CLASS
        self.shapes = {"x": (3, n, HIDDEN), "uzr": (2, HIDDEN, HIDDEN), "un": (HIDDEN, HIDDEN), "wc": (HIDDEN, self.classes), "bc": (self.classes,), "ww": (full, HIDDEN), "bw": (full,)}
        rng = np.random.default_rng(5)
        self.all, self.p = self._space()
        for k, s in self.shapes.items():
            if len(s) == 3:  # gates side by side
                self.p[k][:] = rng.normal(0, 0.1, (s[1], s[0] * s[2])).reshape(s[1], s[0], s[2]).transpose(1, 0, 2)
            elif len(s) > 1:
                self.p[k][:] = rng.normal(0, 0.1, s)
        whole = np.append(mass, np.zeros(full - n)).reshape(-1, CLASS).sum(1) + 0.5
        self.p["bc"][:] = np.log(whole / whole.sum())
        self.p["bw"][:n] = np.log((np.asarray(mass) + 0.5) / np.repeat(whole, CLASS)[:n])
        self.p["bw"][n:] = -1e9  # no place

    def _space(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """One vector, and the parameters as views of it."""
        size = {k: int(np.prod(s)) for k, s in self.shapes.items()}
        one = np.zeros(sum(size.values()), np.float32)
        ends = np.cumsum(list(size.values()))
        return one, {k: one[e - size[k] : e].reshape(s) for e, (k, s) in zip(ends, self.shapes.items())}

    def flat(self) -> np.ndarray:
        return self.all.copy()

    def load(self, flat: np.ndarray) -> None:
        self.all[:] = flat

    def __getstate__(self):
        return {"shapes": self.shapes, "classes": self.classes, "all": self.all}

    def __setstate__(self, state):
        self.shapes, self.classes = state["shapes"], state["classes"]
        self.all, self.p = self._space()
        self.all[:] = state["all"]

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Input table and recurrence with the first two gates at half, for a sigmoid is (tanh(x / 2) + 1) / 2."""
        x = self.p["x"].copy()
        x[:2] *= np.float32(0.5)
        return x, self.p["uzr"] * np.float32(0.5)

    def step(self, x: np.ndarray, h: np.ndarray, gates: tuple[np.ndarray, np.ndarray] | None = None):
        table, u = gates or self.gates()
        g = table.take(x, axis=1)
        zr, n = g[:2], g[2]
        zr += np.matmul(h, u)
        np.tanh(zr, out=zr)
        zr += np.float32(1)
        zr *= np.float32(0.5)
        z, r = zr
        n += (r * h) @ self.p["un"]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n

    @staticmethod
    def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, gw: np.ndarray | None = None, gb: np.ndarray | None = None):
        """Chances of columns y of softmax(h w + b); with gw and gb, adds the gradients of w and b and returns that of h.

        Works on e = exp(h w) and takes exp(b) and the sums of rows into the smaller sides of the products. Biases are
        logarithms of shares, so that rows need their maximum taken off only where weights are large.
        """
        share, steep = np.exp(b), np.abs(w).sum(0).max() > 40  # states are within -1 and 1
        share_w, shares = (w * share).T, np.stack([share, share], 1)  # with two columns a row's sum is the same at any place
        out, dh = np.empty(len(h), h.dtype), None if gw is None else np.empty_like(h)
        target, width = share[y], w.shape[1]
        rows = max(1, _BLOCK // width // 16) * 16  # products round alike in rows of one run of four: blocks split none
        for lo in range(0, len(h), rows):
            cut = slice(lo, lo + rows)
            part = h[cut]
            e = part @ w
            if steep:
                e -= e.max(1, keepdims=True)
            np.exp(e, out=e)
            total = (e @ shares)[:, 0] + np.float32(1e-30)
            flat, at = e.reshape(-1), np.arange(len(part)) * width + y[cut]
            own = flat[at]
            out[cut] = own * target[cut] / total
            if gw is not None:
                flat[at] = own - total / np.maximum(target[cut], np.float32(1e-30))
                total = np.reciprocal(total)[:, None]
                g = (part * total).T @ e
                g *= share
                gw += g
                gb += (total.T @ e)[0] * share
                np.matmul(e, share_w, out=dh[cut])
                dh[cut] *= total
        return out, dh

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """Natural log-probabilities of targets y from states h; with grad, adds its gradients and returns that of h."""
        order = np.argsort((y // CLASS).astype(np.int16), kind="stable")
        h, y = h[order], y[order]
        c = y // CLASS
        chance, dh = self._softmax(h, self.p["wc"], self.p["bc"], c, *(() if grad is None else (grad["wc"], grad["bc"])))
        cut = np.searchsorted(c, np.arange(self.classes + 1))
        within = np.empty_like(chance)
        for k in np.flatnonzero(np.diff(cut)):
            s, rows = slice(k * CLASS, (k + 1) * CLASS), slice(cut[k], cut[k + 1])
            within[rows], d = self._softmax(h[rows], self.p["ww"][s].T, self.p["bw"][s], y[rows] - k * CLASS, *(() if grad is None else (grad["ww"][s].T, grad["bw"][s])))
            if grad is not None:
                dh[rows] += d
        out = np.empty(len(y))
        out[order] = np.log(np.maximum(chance, 1e-30)) + np.log(np.maximum(within, 1e-30))
        if grad is not None:
            dh[order] = dh.copy()
        return out, dh

    def backward(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, h: np.ndarray, grad: dict) -> tuple[float, np.ndarray]:
        """A window of inputs x and targets y (lanes, steps; `on` where real) from states h: adds the gradients of the
        negative log-likelihood to grad, returns its sum and the states after the window."""
        end, steps, lanes = 0, x.shape[1], len(h)
        x = np.ascontiguousarray(x.T)
        first = [np.flatnonzero(row == end) for row in x]
        gates = self.gates()
        before, reset, states = (np.empty((steps, *h.shape), np.float32) for _ in range(3))
        past = []
        for t in range(steps):
            before[t] = h
            before[t, first[t]] = 0
            h, z, r, n = self.step(x[t], before[t], gates)
            past.append((z, r, n))
            states[t] = h
        on = on.T.ravel()
        dout = np.zeros((steps * lanes, HIDDEN), np.float32)
        got, dout[on] = self.outputs(states.reshape(-1, HIDDEN)[on], y.T.ravel()[on], grad)
        dout = dout.reshape(states.shape)
        dh, dx = np.zeros_like(h), np.empty((3, steps, lanes, HIDDEN), np.float32)
        un, uz, ur = (u.T.copy() for u in (self.p["un"], *self.p["uzr"]))
        for t in reversed(range(steps)):
            hp, (z, r, n) = before[t], past[t]
            d = dh + dout[t]
            dz, dr, dn = dx[:, t]
            np.multiply(d * (1 - z), 1 - n * n, out=dn)
            drh = dn @ un
            np.multiply(d * (hp - n), z * (1 - z), out=dz)
            np.multiply(r, hp, out=reset[t])
            np.multiply(drh * reset[t], 1 - r, out=dr)
            dh = d * z
            drh *= r
            dh += drh
            dh += dz @ uz
            dh += dr @ ur
            dh[first[t]] = 0
        dx = dx.reshape(3, -1, HIDDEN)
        grad["un"] += reset.reshape(-1, HIDDEN).T @ dx[2]
        grad["uzr"] += np.matmul(before.reshape(-1, HIDDEN).T, dx[:2])
        at = x.ravel()
        order = np.argsort(at.astype(np.uint16) if self.p["x"].shape[1] <= 1 << 16 else at, kind="stable")
        at = at[order]
        cut = np.flatnonzero(np.append(True, np.diff(at) != 0))
        for g, d in zip(grad["x"], dx):
            g[at[cut]] += np.add.reduceat(np.ascontiguousarray(d[order].T), cut, axis=1).T  # sums of runs, not of strides
        return -float(got.sum()), h

    def train(self, stream: np.ndarray, rate: float) -> int:
        """One pass over a stream of places (whole texts), folded into lanes and padded. Returns the number of tokens."""
        if not len(stream):
            return 0
        end = 0
        width = -(-len(stream) // (LANES * WINDOW)) * WINDOW
        lanes = -(-len(stream) // width)
        y = np.zeros(lanes * width, stream.dtype)
        y[: len(stream)] = stream
        x = np.append(end, y[:-1]).astype(stream.dtype).reshape(lanes, width)
        real = (np.arange(lanes * width) < len(stream)).reshape(lanes, width)
        y = y.reshape(lanes, width)
        h = np.zeros((lanes, HIDDEN), np.float32)
        if not hasattr(self, "m"):
            self.m, self.v, self.t = np.zeros_like(self.all), np.zeros_like(self.all), 0
        grad, views = self._space()
        for lo in range(0, width, WINDOW):
            grad[:] = 0
            w = slice(lo, lo + WINDOW)
            _, h = self.backward(x[:, w], y[:, w], real[:, w], h, views)
            self.t += 1
            warm = rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
            grad /= np.float32(lanes * WINDOW)
            self.m += np.float32(0.1) * (grad - self.m)
            grad *= grad
            self.v += np.float32(0.001) * (grad - self.v)
            np.sqrt(self.v, out=grad)
            grad += np.float32(1e-7)
            np.divide(self.m, grad, out=grad)
            grad *= np.float32(warm)
            self.all -= grad
        return len(stream)

    def score(self, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The natural log-probability of each place, texts by bounds; states are carried to a text's end."""
        out = np.zeros(len(place))
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        start, length = bounds[:-1][order], length[order]
        h, y, gates = np.zeros((len(order), HIDDEN), np.float32), np.zeros(len(order), np.int32), self.gates()
        states, where, targets, size = [], [], [], 0
        steps = int(length[0]) if len(length) else 0
        longer = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than t
        for t, n in enumerate(longer):
            h = self.step(y[:n], h[:n], gates)[0]
            at = start[:n] + t
            y = place[at]
            states.append(h)
            where.append(at)
            targets.append(y)
            size += n
            if t == steps - 1 or (t + 1) % SCORE_WINDOW == 0 and size >= SCORE_ROWS:
                out[np.concatenate(where)] = self.outputs(np.concatenate(states), np.concatenate(targets))[0]
                states, where, targets, size = [], [], [], 0
        return out


def fit(docs: DataFrame, counts: Counts) -> Gru:
    """The network of all texts of docs; `seen` has the number of tokens trained on."""
    model = Gru(counts.mass)
    model.seen = 0
    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("h"))
    for turn in range(ROUNDS):
        rate = 0.01 / (1 + 2 * turn)

        def run(batches, model=model, rate=rate):
            held, size, seen = [], 0, 0

            for b in batches:
                for t, _ in tokens(b.column(0)):
                    held.append(counts.look(t)[1])
                    size += len(t)
                    if size > 1 << 18:
                        seen += model.train(np.concatenate(held), rate)
                        held, size = [], 0
            if held:
                seen += model.train(np.concatenate(held), rate)
            if seen:
                flat = model.flat().astype(np.float64)
                yield pa.record_batch({"i": np.arange(len(flat), dtype=np.int32), "v": flat * seen, "n": np.full(len(flat), float(seen))})

        new = dealt.where(F.col("h") == turn).select("text").mapInArrow(run, "i int, v double, n double")
        mean = new.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n")).toPandas().sort_values("i")
        if len(mean):
            model.load(mean["v"].to_numpy())
            model.seen += int(mean["n"].iloc[0])
    return model


def counted(train: DataFrame) -> tuple[DataFrame, int, int, Counts]:
    """(all word counts, their sum, the number of words, what travels of them)."""
    all_ = scratch.materialize(word_counts(train))
    total, distinct = all_.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = all_.orderBy(F.desc("c"), "w").limit(FREQUENT).toPandas()
    n = buckets(distinct)
    by = all_.groupBy((F.shiftrightunsigned("w", 40) % n).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    tail_c, tail_n = np.zeros(n), np.zeros(n)
    tail_c[by["b"].to_numpy(np.int64)], tail_n[by["b"].to_numpy(np.int64)] = by["c"], by["n"]
    counts = Counts(top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), tail_c, tail_n)
    return all_, total, distinct, counts


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text)."""
    scratch.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out())
    all_, total, distinct, counts = counted(train)
    model = fit(train, counts)
    whole = distinct <= FREQUENT

    def run(batches):
        def scored(t, bounds):
            """Per text: tokens, known ones, base and model sums of log10, and the hashes of the words to be joined."""
            c, place = counts.look(t)
            p = model.score(place, bounds) / np.log(10)
            local = np.log10(np.maximum(c, 0) + 1.0)
            p += np.where(place >= VOCABULARY, local - np.log10(counts.rest[np.maximum(place - VOCABULARY, 0)]), 0)
            lo = bounds[:-1]
            far = np.zeros(len(t), bool) if whole else c < 0
            return np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), lo), np.add.reduceat(local, lo), np.add.reduceat(p, lo), [t[i:j][far[i:j]].view(np.int64) for i, j in zip(lo, bounds[1:])]

        for b in batches:
            parts, held, size = [], [], 0
            for t, bounds in tokens(b.column(1)):
                if held and size + len(t) > SCORE_TOKENS:
                    parts.append(scored(*_joined(held)))
                    held, size = [], 0
                held.append((t, bounds))
                size += len(t)
            if held:
                parts.append(scored(*_joined(held)))
            if parts:
                tail = [x for p in parts for x in p[4]]
                yield pa.record_batch(
                    [b.column(0), b.column(2), *(pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)), pa.array(tail, pa.list_(pa.int64()))],
                    names=["doc_id", "rid", "n_tokens", "n_known", "base", "model", "tail"],
                )

    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id {id_type}, rid long, n_tokens long, n_known long, base double, model double, tail array<long>")
    rows = scratch.materialize(rows)
    far = rows.select("rid", F.explode("tail").alias("w")).join(all_, "w")
    far = far.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("tail").join(far, "rid", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
