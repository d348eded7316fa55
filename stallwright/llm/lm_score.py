"""Scores of whole texts under a gated recurrent language model.

Word counts cover all training texts (a shuffle of each task's own counts). The
VOCABULARY most frequent words travel to the tasks; all rarer ones form the tail,
whose counts are joined. A gated recurrent unit reads the texts; its output softmax
is factored into classes of like probability mass and words within a class. Words
beyond the model's own share one class (two with the tail), within which the counts
give the probability. Words become ids once, in a table that fitting and scoring read.
The weights are fitted in numpy by backpropagation truncated to STEPS words, on all
training texts, whole and of any length: each round's tasks fit on from the same
weights, and a weighted mean by block of weights ends the round. Scoring carries the state on from window to window, so a text's score
is that of the complete text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

FOLDS, HELD_OUT = 5, 1
#: Words whose counts travel to the tasks; words the model tells apart; their classes.
VOCABULARY, MODEL_WORDS, CLASSES = 131_072, 4_096, 64
HIDDEN, STEPS, LANES, SCORE_STEPS = 24, 32, 384, 32
#: Each training text is in one of ROUNDS rounds, chosen by a hash; a round's tasks have
#: about TASK_TOKENS tokens each. Beyond FIT_TASKS tasks each has more texts.
ROUNDS, TASK_TOKENS, FIT_TASKS = 4, 1_280_000, 4_096
FIT_LANES, RATE, BLOCK = 256, 0.03, 16_384
#: A chunk of texts is bounded by about so many bytes, or words (or one text).
CHUNK_BYTES, CHUNK_WORDS = 7_200_000, 1_200_000
#: Rows of a product over tokens at a time, and weights of an update: what stays in a core's cache.
PRODUCT_ROWS, UPDATE_WEIGHTS = 256, 32_768
#: Longer runs of rows are summed one by one.
SHORT_RUN = 16
#: Numbers at one level of the search for the least count.
LEVEL_BITS = 16
END = 0


@dataclass
class Lexicon:
    """The frequent words of two occurrences or more (words met once stand in the tail for
    those not met at all) by falling count, with ids from 1 (0: the end of a text);
    ids from MODEL_WORDS share the class of middling words, id len(count) is the tail."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray  # of the sorted hashes
    count: np.ndarray  # by id
    total: int
    distinct: int

    def __post_init__(self):
        model = min(MODEL_WORDS, len(self.count))
        mass = np.cumsum(self.count[:model] + 0.5)
        group = np.minimum((mass - 0.5 * (self.count[:model] + 0.5)) / mass[-1] * min(CLASSES, model), CLASSES - 1).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1]
        self.model = model
        self.starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.sizes = np.diff(self.starts, append=model)
        self.classes = len(self.starts) + 2  # middling, tail
        self.class_of = np.concatenate([group, np.full(len(self.count) - model, self.classes - 2), [self.classes - 1]])
        middling = self.count[model:]
        self.log_in_class = np.zeros(len(self.count) + 1, np.float32)
        if len(middling):
            self.log_in_class[model:-1] = np.log(middling / middling.sum())
        self.tail_total = self.total - int(self.count.sum())
        self.tail_distinct = self.distinct - int((self.count > 0).sum())
        #: Rows of the input table: the model's words, middling, tail.
        self.input_of = np.minimum(np.arange(len(self.count) + 1), model)
        self.input_of[-1] = model + 1

    @property
    def tail(self) -> int:
        return len(self.count)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.tail)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], self.tail)


def words_met(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrow's texts -> per text its number of words, A-Z lowered (null: none); the numbers
    of all words; the hashes of the different words by number.

    Arrow splits on the white space of words_of, with an empty word where a text starts or
    ends with some. Texts are not cast before: ascii_lower misreads a slice cast to large_string."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy()
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(words), 0)
    length = np.diff(np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[offsets - offsets[0]])
    coded = words.filter(full).dictionary_encode()
    different = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxh64_intdigest, different), np.uint64, len(different)).view(np.int64)
    return length, coded.indices.to_numpy().astype(np.int64), hashes


def numbered(texts, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts (a list or Arrow's), each with its end; per text its number of
    words; the numbers of all words; the hashes of the words by number."""
    import pyarrow as pa

    length, numbers, hashes = words_met(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    tokens = np.full(len(numbers) + len(texts), END, np.int32)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(length + 1) - 1] = False
    tokens[inside] = lexicon.lookup(hashes)[numbers]
    return tokens, length, numbers, hashes


class Steps:
    """Values by step and lane, laid end to end: step t has as many as lanes are active."""

    def __init__(self, flat: np.ndarray, offset: np.ndarray):
        self.flat, self.offset = flat, offset

    def __getitem__(self, at: tuple) -> np.ndarray:
        step, lanes = at
        return self.flat[self.offset[step] : self.offset[step + 1]][lanes]


class Lanes:
    """Texts laid end to end in lanes of like length, the longest lane first. Step t
    has the first active[t] lanes; target, before, text and first have a value for
    each token and no more, so a long text takes no room beside the lanes that ended."""

    def __init__(self, ids: list[np.ndarray], lanes: int):
        heap = [(0, i) for i in range(min(lanes, max(1, len(ids))))]
        members: list[list[int]] = [[] for _ in heap]
        size = [len(x) for x in ids]
        for i in sorted(range(len(ids)), key=lambda i: (-size[i], i)):
            load, lane = heap[0]
            members[lane].append(i)
            heapq.heapreplace(heap, (load + size[i], lane))
        members.sort(key=lambda x: -sum(size[i] for i in x))
        loads = np.array([sum(size[i] for i in x) for x in members])
        steps = int(loads.max(initial=0))
        self.active = len(loads) - np.cumsum(np.bincount(loads, minlength=steps + 1))[:steps]
        self.offset = np.append(0, np.cumsum(self.active))
        order = [i for x in members for i in x]
        length = np.array([size[i] for i in order], np.int64)
        token = np.concatenate([np.asarray(ids[i], np.int32) for i in order]) if order else np.zeros(0, np.int32)
        starts = (np.cumsum(length) - length)[length > 0]
        at = self.offset[np.arange(len(token)) - np.repeat(np.cumsum(loads) - loads, loads)] + np.repeat(np.arange(len(loads)), loads)
        before = np.append(np.int32(END), token[:-1])[: len(token)]
        before[starts] = END
        first = np.zeros(len(token), bool)
        first[starts] = True
        laid = []
        for x in (token, before, np.repeat(np.array(order, np.int32), length), first):
            flat = np.empty_like(x)
            flat[at] = x
            laid.append(Steps(flat, self.offset))
        self.target, self.before, self.text, self.first = laid

    def stop(self, start: int, steps: int, tokens: int) -> int:
        """The end of a window of at least so many steps and, where the lanes have them, tokens."""
        full = int(np.searchsorted(self.offset, self.offset[start] + tokens))
        return min(max(start + steps, full), len(self.active))


def new_weights(lexicon: Lexicon, seed: int = 7) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    w = {"input": draw(lexicon.model + 2, 3 * h), "update": draw(h, 3 * h), "classes": draw(h, lexicon.classes), "words": draw(lexicon.model, h)}
    count = np.append(np.add.reduceat(lexicon.count[: lexicon.model], lexicon.starts), [max(lexicon.count[lexicon.model :].sum(), 0.5), max(lexicon.tail_total, 0.5)])
    w["class_bias"] = np.log((count + 0.5) / (count + 0.5).sum()).astype(np.float32)
    w["word_bias"] = np.log(lexicon.count[: lexicon.model] + 0.5).astype(np.float32)
    return w


def _by_gate(x: np.ndarray) -> np.ndarray:
    """rows x 3 HIDDEN -> 3 x rows x HIDDEN: update gate, reset gate, new state."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def gate_weights(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the input and of the state by gate, those of both logistic functions negated."""
    found = _by_gate(w["input"]), _by_gate(w["update"])
    for x in found:
        np.negative(x[:2], out=x[:2])
    return found


def over_tokens(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of many rows: some hundred rows at a time go twice as fast here."""
    n = len(a) // PRODUCT_ROWS
    whole = n * PRODUCT_ROWS
    out = a[whole:].T @ b[whole:]
    if n:
        out += np.matmul(a[:whole].reshape(n, PRODUCT_ROWS, -1).transpose(0, 2, 1), b[:whole].reshape(n, PRODUCT_ROWS, -1)).sum(axis=0)
    return out


def run_window(
    w: dict[str, np.ndarray], lexicon: Lexicon, lanes: Lanes, start: int, stop: int, state: np.ndarray, keep: bool = False, by_gate: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, list]:
    """The steps start .. stop - 1 -> (states, the state to carry on, what backward needs);
    by_gate: the gate_weights of w, where they are at hand."""
    h, stop = HIDDEN, min(stop, len(lanes.active))
    ends = (lanes.offset[start : stop + 1] - lanes.offset[start]).tolist()
    own = slice(lanes.offset[start], lanes.offset[stop])
    x, first = lexicon.input_of[lanes.before.flat[own]], lanes.first.flat[own]
    fresh = np.logical_or.reduceat(first, ends[:-1]).tolist() if len(x) else []
    going = ~first[:, None]
    table, update = by_gate or gate_weights(w)
    gates = table.take(x, axis=1)
    states = np.empty((len(x), h), gates.dtype)
    old, product = (np.empty_like(states) if keep else None for _ in range(2))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        state = state[: b - a]
        if fresh[i]:
            state = state * going[a:b]
        zr, n, gh = gates[:2, a:b], gates[2, a:b], state @ update
        zr += gh[:2]  # the logistic function in place
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        ghn = gh[2]
        if keep:
            old[a:b], product[a:b] = state, ghn
        ghn *= zr[1]
        n += ghn
        np.tanh(n, out=n)
        new = np.subtract(state, n, out=states[a:b])
        new *= zr[0]
        new += n
        state = new
    return states, state, [ends, x, old, gates, product, going, fresh] if keep else []


def _reach(rows: np.ndarray) -> float:
    """The greatest product that a state, -1 to 1 in each place, can have with a row."""
    return (np.abs(rows) @ np.ones(rows.shape[1], rows.dtype)).max(initial=0)


def _exponentials(q: np.ndarray, bias: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q becomes e ** q, a row's greatest taken off where up to ``reach`` might be too
    much -> (e ** bias but for a factor, sums of both multiplied, log of the true sums)."""
    top = bias.max()
    scale = np.exp(bias - top)
    if reach > 60:
        most = q.max(axis=1)
        q -= most[:, None]
        top = top + most
    np.exp(q, out=q)
    norm = q @ scale
    return scale, norm, np.log(norm) + top


def output(w: dict[str, np.ndarray], lexicon: Lexicon, states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target, and with ``grads`` the slope at the states.

    With s the scale and n the norm of a row, its probabilities are e ** q * s / n; the
    gradients multiply by s and n on their smaller sides."""
    group = lexicon.class_of[target]
    order = np.argsort(group.astype(np.int16), kind="stable")  # rows of one class side by side
    group, target, sorted_states = group[order], target[order], states.take(order, axis=0)
    ends = np.searchsorted(group, np.arange(len(lexicon.starts) + 1)).tolist()
    last = ends[-1]  # from here on the class is all
    rows, heads, words = np.arange(len(target)), w["classes"].T.take(group, axis=0), w["words"].take(target[:last], axis=0)
    q = sorted_states @ w["classes"]
    scale, norm, log_norm = _exponentials(q, w["class_bias"], _reach(w["classes"].T))
    logp = np.einsum("ij,ij->i", sorted_states, heads) + w["class_bias"][group] - log_norm + lexicon.log_in_class[target]
    slope = None
    if grads is not None:
        q[rows, group] -= norm / scale[group]
        share = 1 / norm
        grads["classes"] += over_tokens(sorted_states * share[:, None], q) * scale
        grads["class_bias"] += (share @ q) * scale
        slope = (q @ (w["classes"] * scale).T) * share[:, None]
    logp[:last] += np.einsum("ij,ij->i", sorted_states[:last], words) + w["word_bias"][target[:last]]
    reach = _reach(w["words"])
    for c, (begin, size) in enumerate(zip(lexicon.starts.tolist(), lexicon.sizes.tolist(), strict=True)):
        a, b = ends[c], ends[c + 1]
        if a == b:
            continue
        own, s = slice(begin, begin + size), sorted_states[a:b]
        if size == 1:
            logp[a:b] -= s @ w["words"][begin] + w["word_bias"][begin]
            continue
        q = s @ w["words"][own].T
        scale, norm, log_norm = _exponentials(q, w["word_bias"][own], reach)
        logp[a:b] -= log_norm
        if grads is not None:
            at = target[a:b] - begin
            q[rows[: b - a], at] -= norm / scale[at]
            share = 1 / norm
            grads["words"][own] += (q.T @ (s * share[:, None])) * scale[:, None]
            grads["word_bias"][own] += (share @ q) * scale
            slope[a:b] += (q @ (w["words"][own] * scale[:, None])) * share[:, None]
    back = np.empty_like(order)
    back[order] = rows
    return logp[back], None if slope is None else slope.take(back, axis=0)


def backward(w: dict[str, np.ndarray], slope: np.ndarray, trace: list, grads: dict[str, np.ndarray]) -> None:
    """Through the steps of one window, from last to first, STEPS at a time."""
    h, (ends, x, old, gates, product, going, fresh) = HIDDEN, trace
    z, r, new = gates
    by_new = (1 - z) * (1 - new * new)
    by_z = (old - new) * z * (1 - z)
    by_r = product * r * (1 - r)
    gh, dn = np.empty_like(gates), np.empty_like(new)
    back, carried = np.ascontiguousarray(_by_gate(w["update"]).transpose(0, 2, 1)), np.zeros((0, h), slope.dtype)
    for i in range(len(ends) - 2, -1, -1):
        a, b = ends[i], ends[i + 1]
        d, own = slope[a:b], dn[a:b]
        d[: len(carried)] += carried
        np.multiply(d, by_new[a:b], out=own)
        np.multiply(d, by_z[a:b], out=gh[0, a:b])
        np.multiply(own, by_r[a:b], out=gh[1, a:b])
        np.multiply(own, r[a:b], out=gh[2, a:b])
        carried = np.zeros((0, h), slope.dtype)
        if i % STEPS:
            carried = d * z[a:b]
            for k in range(3):
                carried += gh[k, a:b] @ back[k]
            if fresh[i]:
                carried *= going[a:b]  # nothing flows back over a text's start
    for k in range(3):
        grads["update"][:, k * h : (k + 1) * h] += over_tokens(old, gh[k])
    gx = np.concatenate([gh[0], gh[1], dn], axis=1)
    order = np.argsort(x.astype(np.int16 if len(w["input"]) < 1 << 15 else np.int64), kind="stable")
    x = x[order]  # each input's rows are summed once for the window
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    grads["input"][x[starts]] += sums_of_runs(gx.take(order, axis=0), starts)


def sums_of_runs(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of rows (np.add.reduceat goes value by value here): long runs
    one by one, the first, second, ... rows of all short runs together."""
    size = np.diff(starts, append=len(rows))
    out = rows.take(starts, axis=0)
    for i in np.flatnonzero(size > SHORT_RUN).tolist():
        run = rows[starts[i] : starts[i] + size[i]]
        out[i] = np.ones(len(run), rows.dtype) @ run
    left = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
    for k in range(1, SHORT_RUN):
        out[left] += rows.take(starts[left] + k, axis=0)
        left = left[size[left] > k + 1]
    return out


class Fitting:
    """Adam over windows of at least STEPS steps and FIT_LANES * STEPS tokens, the state
    carried from window to window."""

    def __init__(self, w: dict[str, np.ndarray], lexicon: Lexicon, rate: float):
        self.w, self.lexicon, self.rate, self.updates, self.tokens = w, lexicon, rate, 0, 0
        self.m, self.v, self.grads = ({k: np.zeros(x.shape, x.dtype) for k, x in w.items()} for _ in range(3))
        self.room = np.zeros(UPDATE_WEIGHTS, np.float32)

    def read(self, ids: list[np.ndarray]) -> None:
        lanes, start = Lanes(ids, FIT_LANES), 0
        state = np.zeros((lanes.active[0] if len(lanes.active) else 0, HIDDEN), np.float32)
        while start < len(lanes.active):
            stop = lanes.stop(start, STEPS, FIT_LANES * STEPS)
            states, state, trace = run_window(self.w, self.lexicon, lanes, start, stop, state, keep=True)
            target = lanes.target.flat[lanes.offset[start] : lanes.offset[stop]]
            _, slope = output(self.w, self.lexicon, states, target, self.grads)
            backward(self.w, slope, trace, self.grads)
            self._update(len(target))
            start = stop

    def _update(self, tokens: int) -> None:
        self.updates, self.tokens = self.updates + 1, self.tokens + tokens
        one, two = 1 - 0.9**self.updates, 1 - 0.999**self.updates
        for k, grad in self.grads.items():
            flat = [x.reshape(-1) for x in (grad, self.m[k], self.v[k], self.w[k])]
            for at in range(0, grad.size, UPDATE_WEIGHTS):
                g, m, v, w = (x[at : at + UPDATE_WEIGHTS] for x in flat)
                room = self.room[: len(g)]
                g *= 1 / tokens
                m *= 0.9
                m += np.multiply(g, 0.1, out=room)
                np.multiply(g, g, out=g)
                v *= 0.999
                v += np.multiply(g, 0.001, out=g)
                np.sqrt(np.multiply(v, 1 / two, out=g), out=g)
                g += 1e-8
                np.divide(m, g, out=room)
                w -= np.multiply(room, self.rate / one, out=room)
                g.fill(0)


def _blocks(w: dict[str, np.ndarray]) -> list[bytes]:
    flat = np.concatenate([x.ravel() for x in w.values()])
    return [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]


def _from_blocks(blocks: list[bytes], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(b"".join(blocks), np.float32).copy(), 0, {}
    for k, x in like.items():
        out[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def ids_of(column) -> list[np.ndarray]:
    """Ids of each text, from a binary column of Arrow."""
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def by_tokens(ids: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """The texts in runs of at most so many tokens, or of one text."""
    run, size = [], 0
    for x in ids:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def fit(train: DataFrame, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """train(key, n_tokens, ids) -> the weights, from all its texts; key is a hash that
    tells texts apart. What is collected is one mean for each block of weights; without
    texts the first weights stay as they are."""
    train = train.withColumn("round", F.pmod("key", F.lit(ROUNDS)))
    sizes = {r["round"]: r.n for r in train.groupBy("round").agg(F.sum("n_tokens").alias("n")).collect()}
    weights = new_weights(lexicon)
    for i in sorted(sizes):

        def local(batches: Iterator, weights=weights, rate=RATE * (1 - 0.9 * i / ROUNDS)) -> Iterator:
            import pyarrow as pa

            fitting = Fitting({k: x.copy() for k, x in weights.items()}, lexicon, rate)
            held, size = [], 0
            for b in batches:
                for run in by_tokens(ids_of(b.column(0)), CHUNK_WORDS):
                    held.extend(run)
                    size += sum(map(len, run))
                    if size > CHUNK_WORDS:
                        fitting.read(held)
                        held, size = [], 0
            fitting.read(held)
            blocks = _blocks(fitting.w) if fitting.tokens else []
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "tokens": pa.array([fitting.tokens] * len(blocks), pa.int64()), "w": pa.array(blocks, pa.binary())})

        def mean(pdf):  # a row for each task, FIT_TASKS at most
            share = pdf["tokens"] / pdf["tokens"].sum()
            total = sum(np.frombuffer(w, np.float32) * np.float32(s) for w, s in zip(pdf["w"], share, strict=True))
            return pdf.head(1).assign(w=[total.tobytes()])[["block", "w"]]

        tasks = min(FIT_TASKS, -(-sizes[i] // TASK_TOKENS))
        texts = train.where(F.col("round") == i).select("key", "ids").repartition(tasks).sortWithinPartitions("key").select("ids")
        found = texts.mapInArrow(local, "block int, tokens long, w binary").groupBy("block").applyInPandas(mean, "block int, w binary")
        weights = _from_blocks([bytes(r.w) for r in sorted(found.collect())], weights)
    return weights


def score_texts(w: dict[str, np.ndarray], lexicon: Lexicon, ids: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text but for the tail words' share of the tail."""
    lanes, start = Lanes(ids, LANES), 0
    state = np.zeros((lanes.active[0] if len(lanes.active) else 0, HIDDEN), np.float32)
    logp, by_gate = np.zeros(len(lanes.target.flat)), gate_weights(w)
    while start < len(lanes.active):
        stop = lanes.stop(start, SCORE_STEPS, LANES * SCORE_STEPS)
        states, state, _ = run_window(w, lexicon, lanes, start, stop, state, by_gate=by_gate)
        own = slice(lanes.offset[start], lanes.offset[stop])
        logp[own] = output(w, lexicon, states, lanes.target.flat[own])[0]
        start = stop
    return np.bincount(lanes.text.flat, weights=logp, minlength=len(ids)) / np.log(10)


def held_out() -> F.Column:
    """Texts of this fold are scored, never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def text_runs(texts) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of Arrow's texts of about CHUNK_BYTES bytes, or of one text."""
    import pyarrow.compute as pc

    run = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    yield from zip(starts.tolist(), np.diff(starts, append=len(run)).tolist(), strict=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(text) -> (h, c): count of each word, under its 64-bit hash."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo, n in text_runs(b.column(0)):
                _, numbers, hashes = words_met(b.column(0).slice(lo, n))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(numbers, minlength=len(hashes)))], ["h", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def least_count(counts: DataFrame, n: int) -> int:
    """The smallest count that at most n words reach, 2 at least. Digit by digit, from a
    histogram of at most 2 ** LEVEL_BITS rows each."""
    low = 0
    for shift in range(48, -1, -LEVEL_BITS):
        own = counts.where(F.col("c").between(low, low + (1 << (shift + LEVEL_BITS)) - 1)) if shift < 48 else counts
        digit = F.shiftright("c", shift).bitwiseAND((1 << LEVEL_BITS) - 1)
        rows = sorted(own.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), reverse=True)
        for d, words in rows:
            if words > n:
                low |= d << shift
                break
            n -= words
        else:
            return max(low, 2)
    return max(low + 1, 2)


def build_lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """Of words with equal counts all or none are in the lexicon, VOCABULARY at most."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.where(F.col("c") >= least_count(counts, VOCABULARY)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    h, c = top["h"].to_numpy(np.int64), np.append([texts], top["c"].to_numpy(np.int64))
    order = np.argsort(h)
    return Lexicon(h[order], order + 1, c, int(total[0] or 0) + texts, int(total[1]) + (texts > 0))


def score_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> per row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    A text's tokens are its words, A-Z lowered, and one end. A null text is an empty
    one (its end alone). Repeated rows count and come back each. Without training
    texts every token is unknown. An empty table gives an empty result; other columns
    are ignored. Whole texts are read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    train = rows.where("not held_out")
    counts = written(word_counts(train), "lm-counts")
    lexicon = build_lexicon(counts, train.count())
    log_count = np.append(np.log10(lexicon.count + 0.5), 0.0)

    def number(batches: Iterator) -> Iterator:
        for b in batches:
            for lo, n in text_runs(b.column(1)):
                yield _numbered(b.slice(lo, n), lexicon, log_count)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [score_texts(weights, lexicon, run) for run in by_tokens(ids_of(b.column("ids")), CHUNK_WORDS)]
            own = b.drop_columns("ids")
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate([*found, []]), pa.float64())], [*own.schema.names, "score"])

    columns = "doc_id long, held_out boolean, rid long, n_tokens long, n_tail long, base double"
    laid = rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", "text").alias("key"))
    laid = written(laid.mapInArrow(number, f"{columns}, key long, ids binary, tail array<struct<h:long,n:long>>"), "lm-ids")
    weights = fit(laid.where("not held_out").select("key", "n_tokens", "ids"), lexicon)
    part = written(laid.select("doc_id", "held_out", "rid", "n_tokens", "n_tail", "base", "ids").mapInArrow(score, f"{columns}, score double"), "lm-parts")
    tail = laid.select("rid", F.explode("tail").alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(counts.hint("shuffle_hash"), "h", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("tail_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    whole = float(np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1)))
    within = float(np.log10(lexicon.tail_total + 0.5 * (lexicon.tail_distinct + 1)))
    ends_known = 0 if lexicon.count[END] else 1
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return part.join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_tail") - F.lit(ends_known) + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + tail_log - F.col("n_tail") * F.lit(within)).alias("score"),
    )


def _numbered(rows, lexicon: Lexicon, log_count: np.ndarray):
    """rows(doc_id, text, held_out, rid, key) -> the rows of the table of ids."""
    import pyarrow as pa

    tokens, length, numbers, hashes = numbered(rows.column(1), lexicon)
    n = rows.num_rows
    ends = np.append(0, np.cumsum(length + 1))
    base = np.add.reduceat(log_count[tokens], ends[:-1])
    rare = np.flatnonzero(np.delete(tokens, ends[1:] - 1) == lexicon.tail)
    text = np.repeat(np.arange(n), length)[rare]
    met, times = np.unique(text * len(hashes) + numbers[rare], return_counts=True)
    entries = pa.StructArray.from_arrays([pa.array(hashes[met % max(len(hashes), 1)]), pa.array(times.astype(np.int64))], ["h", "n"])
    tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(met, np.arange(n + 1) * len(hashes)).astype(np.int32)), entries)
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * ends), pa.py_buffer(tokens)]).cast(pa.binary())
    doc_id, _, held, rid, key = rows.columns
    return pa.RecordBatch.from_arrays(
        [doc_id, held, rid, pa.array(length + 1), pa.array(np.bincount(text, minlength=n)), pa.array(base), key, ids, tail], ["doc_id", "held_out", "rid", "n_tokens", "n_tail", "base", "key", "ids", "tail"]
    )


def op5_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op5_gated_lm": op5_gated_lm}
SQL: dict[str, str] = {}
