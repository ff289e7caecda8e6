"""Scoring by a gated recurrent language model with a class-factored softmax, over exact corpus counts.

Counts. Words are counted over every training text; partial counts are summed before they are shuffled. The most frequent
words, at most HEAD (a fixed number), are sent to all tasks. Rarer words meet their counts by a shuffle on the word: none of them
is frequent, so no task gets a hot key.

Model. A minimal gated recurrent unit reads the words of a text: each word has a gate z and a value c, and the state becomes
(1 - z) * state + z * c. Its output vocabulary is the most frequent words, the end of a text, and one symbol for all other
words; they are dealt by frequency into classes of growing size, and a word's probability is that of its class times its share
in the class. For the other words the symbol's probability is multiplied by the word's smoothed share of all such words in the
corpus counts, so every text has a probability.

Training. Every training text is learnt from once. The texts are dealt by a hash into rounds of growing size; in a round each
task trains on the texts of its partition, in numpy by truncated backpropagation with the state carried from window to window,
from the weights of the round before, and the weights that come out are averaged by the tokens they have seen. What is sent is
weights, so its size doesn't depend on the texts; no text reaches the driver.

Scoring. Texts are sorted by length and go through the network side by side, window by window, with the state carried along,
so a text of any length is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, cut, mix64, small_batches, word_hashes

#: Words whose counts are sent to all tasks.
HEAD = 1 << 18
VOCABULARY, CLASSES, HIDDEN = 4096, 40, 24
WINDOW, LANES, SEED = 20, 512, 5
#: The rounds of training: of 64 parts of the training texts, how many each takes, and its rate.
ROUNDS = ((2, 0.02), (8, 0.02), (22, 0.01), (32, 0.005))
#: Bytes of text that a task trains on at once, and that go through the network side by side when they are scored.
TRAINED, GROUP = 4 << 20, 12 << 20
#: Tokens of texts of any number that are scored at once; weights in a message, and sums of messages that reach the driver.
STEP, BLOCK, PARTS = 1 << 13, 1 << 13, 4
OTHER, END = 0, 1
SMOOTHING = 0.1


def class_edges(vocabulary: int, classes: int) -> np.ndarray:
    """The first word of each class, and the vocabulary's size: OTHER and END are classes of their own, the others grow by a
    constant factor, so that frequent words stand in small classes."""

    def sizes(growth: float) -> np.ndarray:
        return np.ceil(4 * growth ** np.arange(classes - 2)).astype(np.int64)

    low, high = 1.0, 2.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sizes(middle).sum() < vocabulary - 2 else (low, middle)
    return np.minimum(np.concatenate([[0, 1, 2], 2 + np.cumsum(sizes(high))]), vocabulary)


class Network:
    """A minimal gated recurrent unit with a class-factored output; frequency: counts of OTHER, END and the other words."""

    def __init__(self, frequency: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        n, h = VOCABULARY, HIDDEN
        self.edges = class_edges(n, CLASSES)
        self.class_of = (np.searchsorted(self.edges, np.arange(n), "right") - 1).astype(np.int16)
        share = np.full(n, 1e-6)
        share[: len(frequency)] += frequency / max(1.0, frequency.sum())
        of_class = np.add.reduceat(share, self.edges[:-1])
        weight = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "gate": weight(0.5, n, h), "value": weight(0.7, n, h), "wc": weight(0.1 / h**0.5, h, CLASSES), "bc": np.log(of_class).astype(np.float32),
            "ww": weight(0.1 / h**0.5, h, n), "bw": np.log(share / of_class[self.class_of]).astype(np.float32),
        }

    def gates(self) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.p["gate"], -30, 30)))

    def states(self, before: np.ndarray, state: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, ...]:
        """For words that stand before (steps x texts) and the state before them: the states, and the shares kept, the gates and
        the values at each step. A state starts anew after END."""
        z, value = gate[before], self.p["value"][before]
        keep = 1 - z
        keep[before == END] = 0
        out = z * value
        for t in range(len(before)):
            out[t] += keep[t] * (out[t - 1] if t else state)
        return out, keep, z, value

    def log_likelihood(self, states: np.ndarray, words: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the words after the states; with grad, also the gradient of the states."""
        p, classes = self.p, self.class_of[words]
        order = np.argsort(classes, kind="stable")
        classes, words, states = classes[order], words[order], states[order]
        to = np.searchsorted(classes, np.arange(len(self.edges)))
        one = np.ones(max(len(words), 1), np.float32)

        def chosen(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
            """The log share of each row's target; with grad, the logits become the gradient of that."""
            rows = np.arange(len(target))
            logits -= logits.max(1, keepdims=True)
            out = logits[rows, target]
            np.exp(logits, out=logits)
            total = logits.sum(1)
            if grad is not None:
                logits *= (-1 / total)[:, None]
                logits[rows, target] += 1
            return out - np.log(total)

        logits = states @ p["wc"] + p["bc"]
        found, back = chosen(logits, classes), None
        if grad is not None:
            grad["wc"] += states.T @ logits
            grad["bc"] += one[: len(words)] @ logits
            back = logits @ p["wc"].T
        for c in range(len(self.edges) - 1):
            (i, j), (a, b) = to[c : c + 2], self.edges[c : c + 2]
            if i == j or b - a < 2:
                continue
            own = states[i:j]
            logits = own @ p["ww"][:, a:b] + p["bw"][a:b]
            found[i:j] += chosen(logits, words[i:j] - a)
            if grad is not None:
                grad["ww"][:, a:b] += own.T @ logits
                grad["bw"][a:b] += one[: j - i] @ logits
                back[i:j] += logits @ p["ww"][:, a:b].T
        out = np.empty_like(found)
        out[order] = found
        if grad is None:
            return out, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return out, unsorted

    def gradient(self, words: np.ndarray, before: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, dict, int]:
        """The state after a window of words (steps x lanes; -1: none), the gradient of its log-likelihood, and its tokens."""
        h = HIDDEN
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        states, keep, z, value = self.states(before, state, self.gates())
        real = words >= 0
        _, back = self.log_likelihood(states[real], words[real], grad)
        into = np.zeros_like(states)
        into[real] = back
        for t in range(len(words) - 2, -1, -1):
            into[t] += keep[t + 1] * into[t + 1]
        earlier = np.concatenate([state[None], states[:-1]])
        earlier[before == END] = 0
        # of each word's gate and value, summed by word
        flat = np.concatenate([into * (value - earlier) * z * (1 - z), into * z], 2).reshape(-1, 2 * h)
        ids = before.reshape(-1)
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sums = np.add.reduceat(flat[order], new)
        grad["gate"][ids[new]], grad["value"][ids[new]] = sums[:, :h], sums[:, h:]
        return states[-1], grad, int(real.sum())

    def flat(self) -> np.ndarray:
        """All weights as one array."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def score(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log10 probability of each text: words[offsets[i]:offsets[i + 1]], whole, whatever its length."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], offsets[:-1][order]
        out, gate = np.zeros(len(sizes)), self.gates()
        state = np.zeros((len(sizes), HIDDEN), np.float32)
        lo, longest = 0, int(sizes[0]) if len(sizes) else 0
        while lo < longest:
            n = int(np.searchsorted(-sizes, -lo, "left"))  # texts longer than lo
            steps = min(max(WINDOW, STEP // n), longest - lo)
            at = lo + np.arange(steps)[:, None]
            real = at < sizes[:n]
            place = np.minimum(starts[:n] + at, len(words) - 1)
            before = np.where(real & (at > 0), words[place - 1], END)
            states = self.states(before, state[:n], gate)[0]
            state = states[-1]
            got, _ = self.log_likelihood(states[real], words[place[real]])
            out[:n] += np.bincount(np.nonzero(real)[1], got.astype(np.float64), n)
            lo += steps
        result = np.zeros(len(sizes))
        result[order] = out / np.log(10)
        return result


class Trainer:
    """Adam steps on a network's weights, over streams of texts in which each ends with END."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps, self.tokens = network, rate, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    def fit(self, stream: np.ndarray) -> None:
        """The stream is cut into lanes that are trained side by side; fewer lanes for a short one, so that it gives as many steps."""
        n = len(stream)
        if not n:
            return
        lanes = max(1, min(LANES, n // (WINDOW * 48)))
        length = -(-n // lanes)
        words, before = np.full(lanes * length, -1), np.full(lanes * length, END)
        words[:n], before[1:n] = stream, stream[:-1]
        words, before = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (words, before))
        state = np.zeros((lanes, HIDDEN), np.float32)
        for lo in range(0, length, WINDOW):
            state, grad, tokens = self.network.gradient(words[lo : lo + WINDOW], before[lo : lo + WINDOW], state)
            self.step(grad, max(1, tokens))
        self.tokens += n

    def step(self, grad: dict, tokens: int) -> None:
        self.steps += 1
        norm = sum(float(np.vdot(g, g)) for g in grad.values()) ** 0.5 / tokens
        scale = np.float32(1 / tokens / max(1.0, norm))
        rate = np.float32(self.rate * min(1.0, self.steps / 20) / (1 - 0.9**self.steps))
        spread = np.float32((1 - 0.99**self.steps) ** -0.5)
        for k, g in grad.items():
            g *= scale
            mean, square = self.moments[k]
            mean += np.float32(0.1) * (g - mean)
            square += np.float32(0.01) * (g * g - square)
            self.network.p[k] += rate * mean / (np.sqrt(square) * spread + np.float32(1e-8))


def _texts(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*bytes_of(part.column(column)))


def _count(batches):
    """Partial counts of the words of the batches' texts."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for part in blocks([batch], "text"):
            hashes, _ = _texts(part, 0)
            held.append(hashes)
            size += len(hashes)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _shorter(hashes: np.ndarray, sorted_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes in a sorted array, and whether they are in it."""
    if not len(sorted_words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(sorted_words, hashes), len(sorted_words) - 1)
    return place, sorted_words[place] == hashes


class Scorer:
    """The head's counts, the network and the constants; runs over batches of (row, doc_id, text)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int):
        order = np.argsort(words)
        self.words, self.counts, self.ends = words[order], counts[order], ends
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        # the most frequent words are numbered from 2; all others are OTHER
        number = np.full(len(words), OTHER, np.int16)
        top = min(len(words), VOCABULARY - 2)
        number[rank[:top]] = np.arange(2, top + 2)
        self.number = number
        self.top_counts = counts[:top]
        self.network: Network | None = None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        place, known = _shorter(hashes, self.words)
        return np.where(known, self.number[place] if len(self.words) else OTHER, OTHER).astype(np.int64)

    def run(self, batches):
        """For each text a row with its sums over the head, and a row for each rarer word and its number in the text."""
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for part in blocks([batch], "text"):
                hashes, at = _texts(part, 2)
                place, known = _shorter(hashes, self.words)
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                n = len(at) - 1
                logs = np.log10(self.counts + SMOOTHING)
                sums = np.bincount(owner[known], logs[place[known]], n) + np.log10(self.ends + SMOOTHING)
                rare = ~known
                number = np.where(known, self.number[place] if len(self.words) else OTHER, OTHER).astype(np.int16)
                other = np.bincount(owner[number == OTHER], minlength=n)
                other_logs = np.bincount(owner[known & (number == OTHER)], logs[place[known & (number == OTHER)]], n)
                rows = part.column(0).to_numpy(zero_copy_only=False)
                group.append((rows, part.column(1), np.diff(at), np.bincount(owner[known], minlength=n) + (self.ends > 0), sums, other, other_logs, number))
                if rare.any():
                    o, h = owner[rare], hashes[rare]
                    order = np.lexsort((h, o))
                    o, h = o[order], h[order]
                    new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
                    zero, times = np.zeros(len(new), np.int64), np.diff(np.append(new, len(o)))
                    yield _out(h[new].view(np.int64), rows[o[new]], pa.nulls(len(new), pa.int64()), times, zero, zero, zero * 0.0, zero, zero * 0.0, zero * 0.0)
                size += part.get_total_buffer_size() if part.num_rows == 1 else int(bytes_of(part.column(2))[1][-1])
                if size >= GROUP:
                    yield self._scored(group)
                    group, size = [], 0
        if group:
            yield self._scored(group)

    def _scored(self, group: list[tuple]) -> pa.RecordBatch:
        rows, words, known, sums, other, other_logs = (np.concatenate([g[k] for g in group]) for k in (0, 2, 3, 4, 5, 6))
        ids = pa.concat_arrays([g[1] for g in group])
        numbers = np.concatenate([np.insert(g[7], np.cumsum(g[2]), END).astype(np.int64) for g in group])  # the end follows each text
        score = self.network.score(numbers, np.concatenate([[0], np.cumsum(words + 1)]))
        # the key of these rows is spread like a word's, and stands for none
        key = mix64(rows.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)
        return _out(key, rows, ids, np.zeros(len(rows), np.int64), words + 1, known, sums, other, other_logs, score)


_SCHEMA = "word long, row long, doc_id long, n long, n_tokens long, known long, sums double, other long, other_sums double, model double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _out(word, row, doc_id, n, n_tokens, known, sums, other, other_sums, model) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.float64(), pa.float64()]
    columns = (word, row, doc_id, n, n_tokens, known, sums, other, other_sums, model)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], _NAMES)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count that at most `most` words reach. The counts' logarithms, in steps of a sixteenth of an
    octave, are counted first: a thousand numbers, whatever the corpus. (A sorted limit would send `most` words of every
    partition to the driver.)"""
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, held = None, 0
    for s, n in sizes:
        held += n
        if held > most:
            break
        lowest = s
    return counts.where(F.lit(False) if lowest is None else step >= lowest)


def _trained(scorer: Scorer, rate: float):
    """Trains the scorer's network on the texts of a partition; the weights that come out are sent in blocks."""

    def run(batches):
        trainer = Trainer(scorer.network, rate)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in blocks([batch], "text", TRAINED):
                hashes, at = _texts(part, 0)
                held.append(np.insert(scorer.numbers(hashes), at[1:], END))
                size += len(bytes_of(part.column(0))[0])
                if size >= TRAINED:
                    trainer.fit(np.concatenate(held))
                    held, size = [], 0
        if held:
            trainer.fit(np.concatenate(held))
        if trainer.tokens:
            flat = scorer.network.flat()
            pieces = [flat[i : i + BLOCK].astype(np.float64) * trainer.tokens for i in range(0, len(flat), BLOCK)]
            yield _message(range(len(pieces)), TaskContext.get().partitionId() % PARTS, trainer.tokens, pieces)

    return run


def _message(places, part: int, tokens: float, pieces: list[np.ndarray]) -> pa.RecordBatch:
    n = len(pieces)
    columns = [pa.array(places, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([float(tokens)] * n), pa.array([x.tobytes() for x in pieces], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "part", "tokens", "sums"])


def _summed(batches):
    """Sums of the messages of each block and part that meet here."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for block, part, tokens, sums in zip(*(c.to_pylist() for c in batch.columns)):
            held = total.setdefault((block, part), [0.0, 0.0])
            held[0] += tokens
            held[1] = held[1] + np.frombuffer(sums)
    for (block, part), (tokens, sums) in sorted(total.items()):
        yield _message([block], part, tokens, [sums])


def _fit(training: DataFrame, scorer: Scorer) -> None:
    """Trains the scorer's network on all texts of training (doc_id, text)."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(sum(n for n, _ in ROUNDS)))
    first = 0
    for n, rate in ROUNDS:
        texts = training.where((place >= first) & (place < first + n)).select("text")
        sent = texts.mapInArrow(_trained(scorer, rate), _MESSAGE).repartition("block", "part").mapInArrow(_summed, _MESSAGE).collect()
        first += n
        if sent:  # PARTS messages of each block, whatever the texts
            flat = np.concatenate([sum(np.frombuffer(r.sums) for r in sent if r.block == b) for b in range(1 + max(r.block for r in sent))])
            scorer.network.set_flat(flat / sum(r.tokens for r in sent if r.block == 0))


_MESSAGE = "block int, part int, tokens double, sums binary"


@dataclass
class Model:
    """What the training texts give: the scorer with its network, counts (word, c), and their sums: tokens, distinct tokens, ends
    of texts, and the tokens and kinds of words that the network calls OTHER."""

    scorer: Scorer
    counts: DataFrame
    total: int
    distinct: int
    ends: int

    @property
    def other(self) -> float:
        return float(self.total - self.ends - self.scorer.top_counts.sum())

    @property
    def other_kinds(self) -> int:
        return self.distinct - (self.ends > 0) - len(self.scorer.top_counts)

    @property
    def base(self) -> float:
        """The weight that all tokens share, one unseen among them, by the smoothed counts."""
        return self.total + SMOOTHING * (self.distinct + 1)

    @property
    def rest(self) -> float:
        """The weight that all words called OTHER share, one unseen among them."""
        return max(0.0, self.other) + SMOOTHING * (self.other_kinds + 1)


def language_model(training: DataFrame, head: int = HEAD) -> Model:
    """The model of all rows of training (doc_id, text; text is not null)."""
    counts = cut(training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    top = most_frequent(counts, head).toPandas().sort_values(["c", "word"], ascending=[False, True])
    scorer = Scorer(top.word.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), ends)
    model = Model(scorer, counts, total + ends, distinct + (ends > 0), ends)
    scorer.network = Network(np.concatenate([[max(model.other, 0.5), ends], scorer.top_counts]).astype(np.float64))
    _fit(training, scorer)
    return model


def language_scores(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs: doc_id, text; other columns are ignored. Null and empty texts are one end token. A text is held out if crc32 of its
    doc_id mod 10 is 0; a null doc_id is never held out. Repeated rows are each counted, learnt from and scored. If every row is
    held out, N and V are 0 and every token is unknown. An empty table gives an empty result. The weights depend, like any
    average of partial fits, on how the rows are dealt into partitions; counts and base scores do not.
    """
    small_batches(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = language_model(docs.where(~held_out), head)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(model.scorer.run, _SCHEMA)
    met = rows.join(model.counts, "word", "left")
    real, c = F.col("n") > 0, F.coalesce("c", F.lit(0))
    log = F.when(real, F.col("n") * F.log10(c + F.lit(SMOOTHING))).otherwise(0.0)
    met = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(real & (c > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("sums") + log).alias("sums"),
        F.sum("other").alias("other"),
        F.sum(F.col("other_sums") + log).alias("other_sums"),
        F.sum("model").alias("model"),
    )
    return met.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * F.log10(F.lit(float(model.base)))).alias("base_score"),
        # the symbol for other words is followed by the word's share among them
        (F.col("model") + F.col("other_sums") - F.col("other") * F.log10(F.lit(float(model.rest)))).alias("score"),
    )
