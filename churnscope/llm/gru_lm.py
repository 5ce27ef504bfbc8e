"""Document log-likelihood by a gated recurrent language model (operator 6).

Tokens are the text's words (A-Z lower-cased) and one end token.  The most frequent words form a shortlist; all other
words share the token ``tail``, and a word's share of the tail is its smoothed frequency in the training texts,
so the model gives every word, seen or not, a probability:

    P(token | state) = P(class | state) * P(token | class, state),   P(word) = P(tail | state) * (c + 0.1) / tail mass.

The shortlist holds every training word, or the MOST most frequent ones where there are more (what a number of two bytes
tells apart); a caller may stop it at a share of the training texts' words.  It is cut by frequency into classes of about the square root of
its size; ``tail`` is a class by itself.  The state is that of a
gated recurrent unit that starts at zero with each document and is carried across all of its windows, so a
document's likelihood is that of the whole text.

Work on Spark, each step a table in the shared folder:

1. One pass over the texts codes each task's documents in blocks of about BLOCK bytes, with the block's own vocabulary and the
   words' numbers of uses in training texts.  The counts of all training texts are their sum by word.
2. Each block gets the counts of its own words back by a join with the written counts (never the whole vocabulary); then documents
   hold shortlist numbers, the frequency baseline and the tail's part of the score.
3. Training, over all windows of all training documents: each task runs truncated back-propagation in numpy from common weights over its
   own documents, and the weights are averaged by the number of tokens (a tree sum).  The ROUNDS rounds take disjoint shares
   of the documents.  The state runs through every window of up to SEGMENT tokens; every token is a target once, and the gradient of its loss
   goes back to its window's start.
4. Scoring lays documents out in parallel streams and runs the model over all of their windows.

Cases: a null or empty text is the end token alone; without any training token the score equals the baseline; a null id is
not held out and not learned from; repeated rows are all scored (and, as training rows, counted); very long texts
make their stream longer than the others; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, materialise, table, tree_sum

HIDDEN = 16
#: A share of the training texts' words for callers that want a smaller shortlist, and its most entries.
COVERAGE, MOST = 0.55, 2**15 - 1
#: Bytes of text that are coded together, and tokens that are scored together, about.
BLOCK, TOGETHER = 24_000_000, 4_000_000
#: The loss is taken in one of EVERY windows: 1 is all of them.
WINDOW, EVERY, SEGMENT = 32, 1, 1024
#: Logits that are held at once, and tokens whose states wait for their probabilities together when texts are scored.
CACHED, SETTLED = 1 << 16, 1 << 16
STREAMS, TRAIN_STREAMS = 512, 512
ROUNDS = (0.25, 1.0)  # upper ends of the documents' shares by hash
RATE, START, TASK_TOKENS = 0.2, 1e-5, 2_000_000
#: Weights that travel together when tasks' models are averaged.
PIECE = 1 << 16
END = 0  # the end token leads the shortlist
SMOOTH = 0.1


# ---------------------------------------------------------------- the model


def shortlist_size(uses: np.ndarray, words: int, coverage: float = COVERAGE) -> int:
    """How many of the most frequent words (their uses, descending) cover ``coverage`` of all ``words`` uses."""
    return int(min(np.searchsorted(np.cumsum(uses), coverage * words) + 1, len(uses), MOST))


def shape(w: dict[str, np.ndarray]) -> tuple[int, int, int]:
    """Classes, words in a class, and the number of the tail's token."""
    classes, size = w["word_bias"].shape
    return classes, size, classes * size


def initial(frequency: np.ndarray, tail: float, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights whose first predictions are the shortlist's frequencies (end token first) and the tail's."""
    rng = np.random.default_rng(seed)
    size = math.ceil(math.sqrt(len(frequency)))
    classes = math.ceil(len(frequency) / size)
    uses = np.full(classes * size, 1e-3)
    uses[: len(frequency)] += frequency
    per_class = uses.reshape(classes, size)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "input": small(classes * size + 1, 3 * HIDDEN),
        "state": (rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))).astype(np.float32),
        "bias": np.zeros(3 * HIDDEN, np.float32),
        "class": small(classes + 1, HIDDEN),
        "class_bias": np.log(np.append(per_class.sum(1), max(tail, 1e-3))).astype(np.float32),
        "word": small(classes, size, HIDDEN),
        "word_bias": np.log(per_class).astype(np.float32),
    }


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def run_window(w: dict, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: bool = False):
    """States after each step of a window (steps x streams x HIDDEN), of which step t predicts token t.

    tokens: the inputs, keep: 0 where a document starts.  The trace holds what back-propagation needs.
    """
    steps, n = tokens.shape
    x = w["input"][tokens]
    states = np.empty((steps, n, HIDDEN), np.float32)
    kept = np.empty((5, steps, n, HIDDEN), np.float32) if trace else None
    for t in range(steps):
        h = h * keep[t][:, None]
        g = h @ w["state"]
        g += w["bias"]
        zr = g[:, : 2 * HIDDEN] + x[t, :, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + r * inner)
        if trace:
            kept[0, t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = z, r, inner, new, h
        h = new + z * (h - new)
        states[t] = h
    return states, h, kept


def _with_one(h: np.ndarray) -> np.ndarray:
    """States with a last entry of 1, which brings in the bias."""
    out = np.ones((len(h), HIDDEN + 1), h.dtype)
    out[:, :HIDDEN] = h
    return out


def _rows(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the classes, and of each class's words, their biases last."""
    return np.concatenate([w["class"], w["class_bias"][:, None]], axis=1), np.concatenate([w["word"], w["word_bias"][:, :, None]], axis=2)


def _small(h: np.ndarray, rows: np.ndarray) -> bool:
    """Whether no exponential of these states' logits can leave the range."""
    return float(np.abs(rows).sum(axis=-1).max(initial=0)) * max(1.0, float(np.abs(h).max(initial=0))) <= 60


def _parts(low: int, high: int, width: int):
    """Slices of so many rows that their logits stay in the processor's cache."""
    step = max(1, CACHED // width)
    for at in range(low, high, step):
        yield slice(at, min(high, at + step))


def _softmax(h: np.ndarray, rows: np.ndarray, at: np.ndarray, small: bool):
    """Exponentials of each state's logits, their sum, and the log probability of each state's entry ``at``."""
    logits = h @ rows.T
    if not small and max(logits.max(initial=0), -logits.min(initial=0)) > 60:
        logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, total, picked - np.log(total)


def log_probabilities(w: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target token given its state."""
    classes, size, _ = shape(w)
    cls = (target // size).astype(np.uint16)
    h, (tops, words) = _with_one(h), _rows(w)
    out = np.empty(len(h), np.result_type(h, tops))
    small = _small(h, tops)
    for part in _parts(0, len(h), len(tops)):
        out[part] = _softmax(h[part], tops, cls[part], small)[2]
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(classes + 1))
    h, at, inner = h[order], (target % size)[order], np.zeros_like(out)
    small = _small(h, words)
    for c in range(classes):
        for part in _parts(ends[c], ends[c + 1], size):
            inner[part] = _softmax(h[part], words[c], at[part], small)[2]
    out[order] += inner
    return out


class Trainer:
    """Adagrad on the weights, one window at a time."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.sq = {k: np.full(v.shape, START, np.float32) for k, v in weights.items()}

    def _step(self, name, grad, at=...):
        grad = np.minimum(np.maximum(grad, np.float32(-1)), np.float32(1))
        self.sq[name][at] += grad * grad
        self.w[name][at] -= RATE * grad / np.sqrt(self.sq[name][at])

    def gradients(self, states, kept, tokens, keep, target, mask):
        """The window's summed loss over a full window's number of tokens, and its gradients; rows of "input" as (ids, rows), of "word" by class."""
        w = self.w
        steps, n = tokens.shape
        flat = np.flatnonzero(mask.ravel())
        h, goal = states.reshape(-1, HIDDEN)[flat], target.ravel()[flat]
        # a full window's mean: windows where few streams are left weigh less
        scale = np.float32(1 / max(len(flat), WINDOW * TRAIN_STREAMS // EVERY))
        classes, size, _ = shape(w)
        cls = (goal // size).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(classes + 1))
        h, cls, goal = _with_one(h[order]), cls[order], goal[order] % size
        tops, words = _rows(w)
        top, word = np.zeros_like(tops), np.zeros_like(words)
        dh, loss = np.zeros((len(flat), HIDDEN), np.result_type(h, tops)), 0.0

        def add(part, rows, at, small, into):
            """A part's loss; its gradients are added to those of the rows and of the states."""
            raised, total, logp = _softmax(h[part], rows, at, small)
            raised[np.arange(len(at)), at] -= total  # the rest is linear: each state's row counts scale / total
            share = (scale / total)[:, None]
            into += raised.T @ (h[part] * share)
            dh[part] += (raised @ rows[:, :HIDDEN]) * share
            return logp.sum()

        small = _small(h, tops)
        for part in _parts(0, len(flat), len(tops)):
            loss += add(part, tops, cls[part], small, top)
        small, found = _small(h, words), []
        for c in range(classes):
            for part in _parts(ends[c], ends[c + 1], size):
                loss += add(part, words[c], goal[part], small, word[c])
            if ends[c] < ends[c + 1]:
                found.append((c, word[c, :, :HIDDEN], word[c, :, HIDDEN]))
        grads = {"class": top[:, :HIDDEN], "class_bias": top[:, HIDDEN], "word": found, "words": word, "input": None}
        dstates = np.zeros((steps * n, HIDDEN), np.float32)
        dstates[flat[order]] = dh
        dstates = dstates.reshape(steps, n, HIDDEN)
        dx, gates = np.empty((2, steps, n, 3 * HIDDEN), np.float32)
        back = np.zeros((n, HIDDEN), np.float32)
        turned = np.ascontiguousarray(w["state"].T)
        for t in range(steps - 1, -1, -1):
            z, r, inner, new, before = kept[:, t]
            d = dstates[t] + back
            dnew = d * (1 - z) * (1 - new * new)
            dg = np.concatenate([d * (before - new) * z * (1 - z), dnew * inner * r * (1 - r), dnew * r], axis=1, out=gates[t])
            dx[t, :, 2 * HIDDEN :] = dnew
            back = (d * z + dg @ turned) * keep[t][:, None]
        dx[:, :, : 2 * HIDDEN] = gates[:, :, : 2 * HIDDEN]
        gates = gates.reshape(-1, 3 * HIDDEN)
        order = np.argsort(tokens, axis=None, kind="stable")
        used, first = np.unique(tokens.ravel()[order], return_index=True)
        summed = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        grads |= {"input": (used, summed), "state": kept[4].reshape(-1, HIDDEN).T @ gates, "bias": gates.sum(0)}
        return -loss * scale, grads

    def learn(self, states, kept, tokens, keep, target, mask):
        loss, g = self.gradients(states, kept, tokens, keep, target, mask)
        for name in ("class", "class_bias", "state", "bias"):
            self._step(name, g[name])
        self._step("input", g["input"][1], g["input"][0])
        self._step("word", g["words"][:, :, :HIDDEN])  # a class without a target has no gradient, and stays
        self._step("word_bias", g["words"][:, :, HIDDEN])
        return loss


def streams_of(lengths: np.ndarray, streams: int) -> list[list[int]]:
    """Documents dealt to streams of about equal length, the longest stream first."""
    streams = max(1, min(streams, len(lengths)))
    loads = [(0, s) for s in range(streams)]
    dealt: list[list[int]] = [[] for _ in range(streams)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, s = heapq.heappop(loads)
        dealt[s].append(d)
        heapq.heappush(loads, (load + int(lengths[d]), s))
    rng = np.random.default_rng(len(lengths))  # long and short documents mixed, so that training windows are alike
    return sorted((rng.permutation(ds).tolist() for ds in dealt), key=lambda ds: -int(lengths[ds].sum()))


def lay_out(docs: list[np.ndarray], streams: int):
    """Targets, inputs and keep flags (steps x streams), each document's streams and starts, and the streams' lengths.

    docs: token numbers without the end token, which is put behind each.
    """
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    dealt = streams_of(lengths, streams)
    size = np.array([lengths[ds].sum() for ds in dealt])
    target = np.full((int(size.max()), len(dealt)), END, np.int32)
    source = np.full(target.shape, END, np.int32)
    keep = np.ones(target.shape, np.float32)
    stream, start = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    for s, ds in enumerate(dealt):
        at = 0
        for d in ds:
            n = len(docs[d])
            target[at : at + n, s] = docs[d]
            source[at + 1 : at + n + 1, s] = docs[d]
            keep[at, s] = 0
            stream[d], start[d] = s, at
            at += n + 1
    return target, source, keep, stream, start, size


def train_documents(trainer: Trainer, docs: list[np.ndarray]) -> None:
    """One pass over documents.  Those above SEGMENT tokens go on in other streams, from a zero state there, lest the
    last windows be those of a few long documents only."""
    parts = [d[at : at + SEGMENT] for d in docs for at in range(0, max(1, len(d)), SEGMENT)]
    total = sum(map(len, parts)) + len(parts)
    target, source, keep, _, _, size = lay_out(parts, min(TRAIN_STREAMS, total // SEGMENT))
    h = np.zeros((target.shape[1], HIDDEN), np.float32)
    for k, at in enumerate(range(0, len(target), WINDOW)):
        n = int((size > at).sum())  # streams are sorted by length: the others have ended
        part = slice(at, at + WINDOW)
        states, h, kept = run_window(trainer.w, source[part, :n], keep[part, :n], h[:n], trace=True)
        turn = np.arange(n) % EVERY == k % EVERY if n >= EVERY > 1 else slice(None)
        mask = (np.arange(at, at + len(states))[:, None] < size[None, :n])[:, turn]
        trainer.learn(states[:, turn], kept[:, :, turn], source[part, :n][:, turn], keep[part, :n][:, turn], target[part, :n][:, turn], mask)


def score_documents(w: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each document's tokens and end, the tail's shares left out."""
    target, source, keep, stream, start, size = lay_out(docs, STREAMS)
    h = np.zeros((target.shape[1], HIDDEN), np.float32)
    sums = np.zeros((len(target) + 1, target.shape[1]))
    held, tokens = [], 0

    def settle():
        logs = log_probabilities(w, np.concatenate([states for states, _, _ in held]), np.concatenate([goal.ravel() for _, goal, _ in held]))
        for _, goal, at in held:
            sums[at + 1 : at + 1 + len(goal), : goal.shape[1]] = logs[: goal.size].reshape(goal.shape)
            logs = logs[goal.size :]

    for at in range(0, len(target), WINDOW):
        n = int((size > at).sum())
        part = slice(at, at + WINDOW)
        states, h, _ = run_window(w, source[part, :n], keep[part, :n], h[:n])
        held.append((states.reshape(-1, HIDDEN), target[part, :n], at))  # windows of a few long streams wait for others
        tokens += target[part, :n].size
        if tokens >= SETTLED:
            settle()
            held, tokens = [], 0
    if held:
        settle()
    np.cumsum(sums, axis=0, out=sums)
    end = start + np.array([len(d) + 1 for d in docs], np.int64)
    return sums[end, stream] - sums[start, stream]


# ---------------------------------------------------------------- the work on Spark


def code_texts(texts) -> tuple[np.ndarray, np.ndarray, object]:
    """Word numbers of all texts of an Arrow array, each text's number of words, and the words by number.

    Arrow's ASCII rules are those wanted: only A-Z change, and words end at U+0020 and U+0009 to U+000D.
    """
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    empty = words.index("").as_py()  # before the first and after the last separator
    if empty >= 0:
        inside = codes != empty
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner[inside], minlength=len(sizes))
        codes = codes[inside]
        codes -= codes > empty
        words = words.take(np.delete(np.arange(len(words)), empty))
    return codes, sizes, words


def planes(codes: np.ndarray) -> bytes:
    """Numbers below 2**31 as their low halves, then their high ones, which compress well."""
    return (codes & 0xFFFF).astype(np.uint16).tobytes() + (codes >> 16).astype(np.uint16).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, np.uint16).reshape(2, -1).astype(np.int32)
    return halves[0] | halves[1] << 16


def _coded(docs: DataFrame, learned: Column) -> DataFrame:
    """Documents (word is null) and block vocabularies (ids is null, number is the word's in its block)."""
    schema = "block long, doc_id long, learned boolean, ids binary, number int, word binary, uses long"

    def run(batches):
        from pyspark import TaskContext

        kinds = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("learned", pa.bool_()), ("ids", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("uses", pa.int64())])
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
            codes, sizes, words = code_texts(texts if isinstance(texts, pa.Array) else texts.chunk(0))
            own = rows["learned"].to_numpy()
            uses = np.bincount(codes[np.repeat(own, sizes)], minlength=len(words))
            ids = [planes(x) for x in np.split(codes, np.cumsum(sizes)[:-1])]
            n, none = rows.num_rows, pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), rows["doc_id"].combine_chunks(), rows["learned"].combine_chunks(), pa.array(ids, pa.binary()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.int64())], schema=kinds)
            for at in range(0, len(words), 100_000):
                some = words[at : at + 100_000].cast(pa.binary())
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), some, pa.array(uses[at : at + n])], schema=kinds)

        for batch in batches:
            at = 0
            ends = np.cumsum(np.asarray(batch.column("bytes")))
            while at < batch.num_rows:  # as many rows as fill the block, one at least
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + BLOCK - size, side="right")))
                held.append(batch.slice(at, end - at))
                size += int(ends[end - 1] - before)
                at = end
                if size >= BLOCK or at < batch.num_rows:
                    yield from flush()
                    block, held, size = block + 1, [], 0
        if held:
            yield from flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(run, schema)


def _counted(coded: DataFrame, counts: DataFrame, known: dict) -> DataFrame:
    """Documents with shortlist numbers, baseline and the tail's part."""
    short = pa.table({"word": pa.array(known["shortlist"], pa.binary()), "short": pa.array(np.arange(1, len(known["shortlist"]) + 1), pa.int32())})
    share = F.broadcast(coded.sparkSession.createDataFrame(short))  # at most MOST rows
    words = coded.filter("word is not null").select("block", "number", "word")
    none = known["none"]
    # a word has one row for each block; without a row in counts no training text holds it
    vocabulary = words.join(counts, "word", "left").join(share, "word", "left")
    vocabulary = vocabulary.select(F.col("block").alias("of"), F.col("number").alias("code"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("short", F.lit(none)).alias("short"))
    own = coded.filter("word is null").select("block", F.col("doc_id").cast("string").alias("doc_id"), "learned", "ids")
    total, tail, end = known["total"], known["tail"], known["end"]

    def join(left, right):
        if not len(left):
            return pd.DataFrame({"doc_id": [], "learned": [], "n_tokens": [], "n_known": [], "base_score": [], "tail_score": [], "ids": []})
        size = int(right["code"].max()) + 1 if len(right) else 0
        c, short = np.zeros(size, np.int64), np.full(size, none, np.uint16)
        if size:
            c[right["code"].to_numpy()], short[right["code"].to_numpy()] = right["c"].to_numpy(), right["short"].to_numpy()
        log = np.log10(c + SMOOTH)
        in_tail = np.where(short == none, log - math.log10(tail), 0.0)
        rows = []
        for doc_id, learned, ids in zip(left["doc_id"], left["learned"], left["ids"]):
            ids = from_planes(ids)
            n = len(ids) + 1
            base = log[ids].sum() + math.log10(end + SMOOTH) - n * math.log10(total)
            rows.append((doc_id, learned, n, int((c[ids] > 0).sum()) + (end > 0), base, in_tail[ids].sum(), short[ids].tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "learned", "n_tokens", "n_known", "base_score", "tail_score", "ids"])

    return own.groupBy("block").cogroup(vocabulary.groupBy("of")).applyInPandas(join, "doc_id string, learned boolean, n_tokens long, n_known long, base_score double, tail_score double, ids binary")


def train(docs: DataFrame, weights: dict[str, np.ndarray], tokens: int) -> dict[str, np.ndarray]:
    """Train on the ``learned`` rows of (doc_id, learned, ids) in ROUNDS rounds of local training and averaging."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    low = 0.0
    for high in ROUNDS:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, shared=shared):
            trainer, seen, held, size = Trainer(shared.value), 0, [], 0
            for pdf in batches:
                for ids in pdf["ids"]:
                    held.append(np.frombuffer(ids, np.uint16))
                    size += len(held[-1]) + 1
                    if size >= TASK_TOKENS:
                        train_documents(trainer, held)
                        seen, held, size = seen + size, [], 0
            if held:
                train_documents(trainer, held)
            seen += size
            return np.append(pack(trainer.w).astype(np.float64) * seen, seen) if seen else None

        own = docs.filter(F.col("learned") & (place >= low) & (place < high)).select("ids")
        own = own.coalesce(max(1, math.ceil(tokens * (high - low) / TASK_TOKENS)))
        summed = tree_sum(own, run, PIECE)
        if summed is not None:
            weights = unpack(summed[:-1] / summed[-1], weights)
        low = high
    return weights


def score(docs: DataFrame, learned: Column, coverage: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
    coded = materialise(_coded(docs, learned), "coded", "zstd")
    counts = materialise(coded.filter("word is not null").groupBy("word").agg(F.sum("uses").alias("c")).filter("c > 0"), "counts", "zstd")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = coded.filter("word is null and learned").count()
    top = counts.orderBy(F.desc("c"), "word").limit(MOST).collect()  # MOST rows of a word and a number
    top = top[: shortlist_size(np.array([r["c"] for r in top], np.int64), stats["n"], coverage)] if top else []
    train_tokens, kinds = stats["n"] + end, stats["v"] + (end > 0)
    total = train_tokens + SMOOTH * (kinds + 1)
    frequency = np.array([end] + [r["c"] for r in top], float)
    tail = total - (frequency + SMOOTH).sum() if end else total
    weights = initial(frequency, tail)
    known = {"shortlist": [bytes(r["word"]) for r in top], "none": shape(weights)[2], "total": total, "tail": max(tail, SMOOTH), "end": end}
    ready = materialise(_counted(coded, counts, known), "counted", "zstd")
    if train_tokens:
        weights = train(ready, weights, train_tokens)
        shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for pdf in batches:
            at = 0
            sizes = pdf["n_tokens"].to_numpy()
            while at < len(pdf):
                end_at = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER)) + at)
                part = pdf.iloc[at:end_at]
                if train_tokens:
                    logs = score_documents(shared.value, [np.frombuffer(x, np.uint16) for x in part["ids"]]) / math.log(10) + part["tail_score"].to_numpy()
                else:
                    logs = part["base_score"].to_numpy()
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("string").astype("Int64"), "n_tokens": part["n_tokens"], "n_known": part["n_known"], "base_score": part["base_score"], "score": logs})
                at = end_at

    out = ready.select("doc_id", "n_tokens", "n_known", "base_score", "tail_score", "ids").mapInPandas(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc32_mod(F.col("doc_id"), 10)
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), rest != 0)
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SPARK = {"op6_gru_lm": op6_gru_lm}
SQL: dict[str, str] = {}
