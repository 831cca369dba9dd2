"""Log-probabilities of whole documents: smoothed word counts and a gated recurrent network.

*Counts.* Documents are dealt into chunks of about CHUNK_BYTES. Each chunk names its distinct
words once with its training counts; these are summed over all chunks and joined back to each
chunk, so what moves is the chunks' vocabularies and not their running words. Words are keyed
by a 64-bit hash.

*Model.* A network with HIDDEN gated units reads the words before and gives each next word by
class and then inside its class; the VOCABULARY most frequent words have their own place, all
others share one, which hands on to the smoothed counts. So the probabilities of all words
sum to 1. It is trained by backpropagation through WINDOW words, the state carried from window
to window, in every partition on SHARE of its training documents per round; after each round
the partitions' weights are averaged, by words trained. The rounds take disjoint shares until
every training document was used once. More input means more of all that.

*Scoring.* The state runs through the whole document, whatever its length, and begins anew at
the next one.

Defined results: null or empty text is one token, its end; a null doc_id is held out from
learning; rows of a repeated doc_id are learned from and scored row by row; without training
documents every word is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

CHUNK_BYTES = 16 << 20
VOCABULARY, MEMBERS, HIDDEN, WINDOW = 1024, 32, 24, 32
STREAMS, SHARE = 256, 1 / 2
#: Words outside the vocabulary are read by their last two bytes.
ENDINGS = 256
#: Words scored at once, and words of a partition trained on at once.
SCORED_WORDS, TRAINED_WORDS = 1 << 20, 1 << 20
#: Rows whose probabilities are worked out in one go.
_BLOCK = 8192
HELD_OUT, DIVISOR = 2, 7
END_KEY = np.uint64(0x5851F42D4C957F2D)
_SLICE = 2000
# Bytes of the texts cut into words at once: what is made of them stays in a core's cache.
PIECE_BYTES = 1 << 17


class Network:
    """The weights, and the passes over them. Place 0 of the vocabulary is for all other words, place 1 for the end."""

    NAMES = ("read", "again", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, keys: np.ndarray, counts: np.ndarray, others: float):
        """``keys``, ``counts``: of the words from place 1 on; ``others``: tokens of all other words."""
        rng = np.random.default_rng(9)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.sorted_places = keys[order], (np.arange(len(keys)) + 1)[order]
        size = len(keys) + 1
        classes = -(-size // MEMBERS)
        weight = np.full(classes * MEMBERS, 1e-9)
        weight[:size] = np.concatenate(([others], counts)) + 0.5
        weight = weight.reshape(classes, MEMBERS)
        self.used = (np.arange(classes * MEMBERS) < size).reshape(classes, MEMBERS)
        self.read = rng.normal(0, 0.1, (size + ENDINGS, 3 * HIDDEN)).astype(np.float32)
        self.again = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.to_class = np.zeros((HIDDEN, classes), np.float32)
        self.class_bias = np.log(weight.sum(axis=1) / weight.sum()).astype(np.float32)
        self.to_word = np.zeros((classes, HIDDEN, MEMBERS), np.float32)
        self.word_bias = np.where(self.used, np.log(weight / weight.sum(axis=1, keepdims=True)), -1e4).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            w = getattr(self, n)
            setattr(self, n, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The vocabulary places of words."""
        at = _looked_up(keys, self.sorted_keys)
        return np.append(self.sorted_places, 0)[at].astype(np.int32)

    def inputs(self, places: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return np.where(places > 0, places, len(self.sorted_keys) + 1 + endings).astype(np.int32)

    def step(self, read: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates, candidate, recurrent part of the candidate) for inputs already looked up.

        All have a row for each text; inside, texts are columns, so that gates and candidate are whole runs of memory."""
        read, state, again = read.T, state.T, self.again.T @ state.T
        gates, inner = again[: 2 * HIDDEN], again[2 * HIDDEN :]
        gates += read[: 2 * HIDDEN]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        candidate = gates[HIDDEN:] * inner
        candidate += read[2 * HIDDEN :]
        np.tanh(candidate, out=candidate)
        new = np.subtract(state, candidate, out=np.empty_like(candidate))
        new *= gates[:HIDDEN]
        new += candidate
        return new.T, gates.T, candidate.T, inner.T

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities."""
        out = np.empty(len(targets), np.float32)
        for at in range(0, len(targets), _BLOCK):
            flat, goal = states[at : at + _BLOCK], targets[at : at + _BLOCK]
            kind, member = np.divmod(goal, MEMBERS)
            logits = self.to_class.T @ flat.T
            logits += self.class_bias[:, None]
            own = logits[kind, np.arange(len(goal))]
            own -= _log_sum(logits)
            order, _, inside, runs = self._inside(flat, kind)
            inner = inside[member[order], np.arange(len(goal))]
            inner -= _log_sum(inside, runs)
            own[order] += inner
            out[at : at + _BLOCK] = own
        return out

    def _inside(self, flat: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """An order of the rows ``flat`` by class, the rows in it, the logits of their classes' members as columns, and the run of each class."""
        order = _order(kind, len(self.to_word))
        bounds = np.searchsorted(kind[order], np.arange(len(self.to_word) + 1)).tolist()
        runs = [(k, slice(low, high)) for k, (low, high) in enumerate(itertools.pairwise(bounds)) if high > low]
        flat, inside = np.take(flat, order, axis=0), np.empty((MEMBERS, len(kind)), np.float32)
        for k, run in runs:
            np.matmul(self.to_word[k].T, flat[run].T, out=inside[:, run])
            inside[:, run] += self.word_bias[k][:, None]
        return order, flat, inside, runs

    def gradients(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the mean loss over one window (words by streams) and the state after it; ``fresh`` words begin a text."""
        steps, streams = inputs.shape
        n = targets.size
        # Streams are columns in each step, and words in the logits, so that all passes run along long rows.
        kept, states, state = [], np.empty((steps, streams, HIDDEN), np.float32), state.T
        live = [None if not row.any() else ~row for row in fresh]
        for t in range(steps):
            before = state if live[t] is None else state * live[t]
            after = self.step(np.take(self.read, inputs[t], axis=0), before.T)
            state, gates, candidate, inner = (x.T for x in after)
            kept.append((before, gates, candidate, inner))
            states[t] = state.T
        flat, goal = states.reshape(-1, HIDDEN), targets.reshape(-1)
        kind, member = np.divmod(goal, MEMBERS)
        chance = self.to_class.T @ flat.T
        chance += self.class_bias[:, None]
        _error(chance, kind)
        d_to_class, d_class_bias = (chance @ flat).T, chance.sum(axis=1)
        d_states = chance.T @ self.to_class.T
        d_to_word, d_word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        order, flat, inside, of_class = self._inside(flat, kind)
        _error(inside, member[order], of_class)
        d_inner = np.empty((n, HIDDEN), np.float32)
        for k, run in of_class:
            d_to_word[k], d_word_bias[k] = (inside[:, run] @ flat[run]).T, inside[:, run].sum(axis=1)
            np.matmul(inside[:, run].T, self.to_word[k].T, out=d_inner[run])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        d_states += np.take(d_inner, back, axis=0)
        d_states = d_states.reshape(steps, streams, HIDDEN)
        d_read = np.empty((steps, streams, 3 * HIDDEN), np.float32)
        d_again, ahead = np.zeros_like(self.again), np.zeros((HIDDEN, streams), np.float32)
        through = np.empty((3 * HIDDEN, streams), np.float32)
        d_gates, d_inside = through[: 2 * HIDDEN], through[2 * HIDDEN :]
        for t in range(steps - 1, -1, -1):
            before, gates, candidate, inner = kept[t]
            update, reset = gates[:HIDDEN], gates[HIDDEN:]
            rest = 1 - gates
            d = ahead
            d += d_states[t].T
            np.subtract(before, candidate, out=d_gates[:HIDDEN])
            d_gates[:HIDDEN] *= d
            d_candidate = d * rest[:HIDDEN]
            candidate *= candidate
            d_candidate *= np.subtract(1, candidate, out=candidate)
            np.multiply(d_candidate, inner, out=d_gates[HIDDEN:])
            d_gates *= gates
            d_gates *= rest
            np.multiply(d_candidate, reset, out=d_inside)
            d_again += before @ through.T
            d_read[t] = through.T
            d *= update
            d += (d_read[t] @ self.again.T).T
            d_read[t, :, 2 * HIDDEN :] = d_candidate.T
            if live[t] is not None:
                d *= live[t]
        d_table = np.zeros_like(self.read)
        flat_in = inputs.reshape(-1)
        order = _order(flat_in, len(self.read))
        own = flat_in[order]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        d_table[own[begins]] = np.add.reduceat(np.take(d_read.reshape(-1, 3 * HIDDEN), order, axis=0), begins, axis=0)
        return [d_table, d_again, d_to_class, d_class_bias, d_to_word, d_word_bias], state.T

    def train(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, rate: float = 0.01) -> None:
        """One pass over a run of words, as up to STREAMS streams side by side, in windows; Adam on each window."""
        streams = int(np.clip(len(targets) // (WINDOW * 32), 4, STREAMS))
        length = -(-len(targets) // streams)
        if not length:
            return
        # The last stream is filled up with the first words, so that no word is left out.
        fold = lambda x: np.resize(x, streams * length).reshape(streams, length).T
        inputs, fresh, targets = fold(inputs), fold(fresh).copy(), fold(targets)
        fresh[0] = True
        parts = [getattr(self, n) for n in self.NAMES]
        first, second = [np.zeros_like(w) for w in parts], [np.zeros_like(w) for w in parts]
        state = np.zeros((streams, HIDDEN), np.float32)
        for number, at in enumerate(range(0, length, WINDOW), 1):
            gradients, state = self.gradients(inputs[at : at + WINDOW], fresh[at : at + WINDOW], targets[at : at + WINDOW], state)
            scale = min(1.0, 1.0 / (1e-9 + math.sqrt(sum(float((g * g).sum()) for g in gradients))))
            for w, g, m, v in zip(parts, gradients, first, second, strict=True):
                g *= np.float32(scale)
                m += 0.1 * (g - m)
                g *= g
                g -= v
                g *= 0.01
                v += g
                root = np.divide(v, 1 - 0.99**number, out=g)
                np.sqrt(root, out=root)
                root += 1e-8
                move = m / (1 - 0.9**number)
                move *= rate
                move /= root
                w -= move

    def score(self, inputs: np.ndarray, targets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of natural log-probabilities of each text; ``bounds`` cut the words into texts, none of them empty."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        out, at = np.zeros(len(sizes)), 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), SCORED_WORDS, "right")) + at)
            own = order[at:upto]
            begin, size = bounds[:-1][own], sizes[own]
            live = np.searchsorted(-size, -np.arange(size[0]), "left")
            total = np.zeros(len(own))
            state = np.zeros((HIDDEN, len(own)), np.float32)
            held, places, filled = [], [], 0
            for t, n in enumerate(live.tolist()):
                place = begin[:n] + t
                state = self.step(np.take(self.read, inputs[place], axis=0), state[:, :n].T)[0].T
                held.append(state)
                places.append(place)
                filled += n
                if filled >= SCORED_WORDS // 8 or t + 1 == len(live):
                    texts = np.concatenate([np.arange(len(p)) for p in places])
                    found = self.log_probabilities(np.concatenate(held, axis=1).T, targets[np.concatenate(places)])
                    total += np.bincount(texts, found, len(own))
                    held, places, filled = [], [], 0
            out[own] = total
            at = upto
        return out


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers below ``most``; of small types it is found by radix."""
    return np.argsort(numbers.astype(np.min_scalar_type(most)), kind="stable")


def _looked_up(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each key is ``among`` distinct ones, or -1, by a table of hashes."""
    found = pc.index_in(pa.array(keys), value_set=pa.array(among))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)


def _sums(x: np.ndarray, runs: Sequence[tuple[int, slice]]) -> np.ndarray:
    """Sums of the columns; a run of a single column is summed by itself, which numpy rounds as a column on its own."""
    out = x.sum(axis=0)
    for _, run in runs:
        if run.stop - run.start == 1:
            out[run] = x[:, run.start].sum()
    return out


def _log_sum(x: np.ndarray, runs: Sequence[tuple[int, slice]] = ()) -> np.ndarray:
    """Logarithms of the sums of exponentials, column by column; ``x`` is overwritten."""
    top = x.max(axis=0)
    x -= top
    np.exp(x, out=x)
    out = np.log(_sums(x, runs))
    out += top
    return out


def _error(x: np.ndarray, rows: np.ndarray, runs: Sequence[tuple[int, slice]] = ()) -> None:
    """Turns logits, column by column, into the gradients of the mean loss if ``rows`` were right."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= _sums(x, runs)
    x[rows, np.arange(len(rows))] -= 1
    x /= len(rows)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and endings of all tokens of a slice, each text's words and then its end; and where each text begins."""
    pieces = shared.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), most=PIECE_BYTES)
    keys, endings, first = zip((np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(1, np.int64)), *(_tokens(p.column("text")) for p in pieces), strict=True)
    return np.concatenate(keys), np.concatenate(endings), np.cumsum(np.concatenate([first[0], *(np.diff(f) for f in first[1:])]))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = shared.text_bytes(column)
    data = shared.LOWER[data]
    starts, ends, first = shared.word_bounds(data, offsets)
    words = shared.span_hashes(data, starts, ends)
    tail = data[ends - 1].astype(np.int64) * 7 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0) if len(ends) else np.empty(0, np.int64)
    n = len(offsets) - 1
    keys, endings = np.insert(words, first[1:], END_KEY), np.insert(tail % ENDINGS, first[1:], 0)
    return keys, endings.astype(np.int32), first + np.arange(n + 1)


def chunked(docs: DataFrame, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, doc_id, text, learned): documents with the number of their chunk, written to the shared folder."""
    learned = F.coalesce(shared.remainder("doc_id", DIVISOR) != HELD_OUT, F.lit(False))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text")).withColumn("learned", learned)
    schema = shared.fields(("chunk", T.LongType()), ("doc_id", T.LongType()), ("text", T.StringType()), ("learned", T.BooleanType()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, held = TaskContext.get().partitionId() << 24, 0, 0
        for part in shared.slices(batches):
            size = part.column("text").nbytes
            if held and held + size > chunk_bytes:
                count, held = count + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, base + count)), *(part.column(c) for c in ("doc_id", "text", "learned"))], names=schema.names)

    return shared.cut(source.mapInArrow(number, schema), "chunks")


def vocabularies(chunks: DataFrame) -> DataFrame:
    """(chunk, key, n): the distinct words of each chunk with their counts in its training documents."""
    schema = shared.fields(("chunk", T.LongType()), ("key", T.LongType()), ("n", T.LongType()))

    def emit(chunk: int, keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
        named = pa.array(np.concatenate(keys).view(np.int64)).dictionary_encode()
        n = np.bincount(named.indices.to_numpy(), np.concatenate(marks), len(named.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), named.dictionary, pa.array(n)], names=schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a chunk follow each other; a chunk cut by a split of its file is named twice, which the sums take.
        now, keys, marks = None, [], []
        for part in shared.slices(batches):
            owners = part.column("chunk").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if keys and owners[a] != now:
                    yield emit(now, keys, marks)
                    keys, marks = [], []
                now = int(owners[a])
                piece = part.slice(a, b - a)
                own, _, first = tokens(piece.column("text"))
                keys.append(own)
                marks.append(np.repeat(piece.column("learned").to_numpy(zero_copy_only=False), np.diff(first)))
        if keys:
            yield emit(now, keys, marks)

    return shared.cut(chunks.select("chunk", "text", "learned").mapInArrow(read, schema), "vocabularies")


def _averaged(trained: DataFrame) -> list:
    """Sums over partitions of weight times values, slice by slice, in two steps."""
    schema = shared.fields(("slice", T.IntegerType()), ("part", T.IntegerType()), ("words", T.DoubleType()), ("total", T.BinaryType()))

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows["total"][0].as_py()) // 8)
        for value in rows["total"]:
            total += np.frombuffer(value.as_py(), np.float64)
        return pa.table({"slice": rows["slice"][:1], "part": rows["part"][:1], "words": pa.array([float(np.sum(rows["words"].to_numpy()))]), "total": pa.array([total.tobytes()])})

    some = trained.withColumn("part", (F.col("part") % 32).cast("int")).groupBy("slice", "part").applyInArrow(add, schema)
    return some.withColumn("part", F.lit(0)).groupBy("slice").applyInArrow(add, schema).collect()


def train(chunks: DataFrame, network: Network, share: float = SHARE) -> Network:
    """The network trained once on every training document, ``share`` of them in each round."""
    schema = shared.fields(("slice", T.IntegerType()), ("part", T.IntegerType()), ("words", T.DoubleType()), ("total", T.BinaryType()))
    rounds = round(1 / share)
    for turn in range(rounds):
        sent = chunks.sparkSession.sparkContext.broadcast(network)
        chosen = chunks.where("learned").where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, words, held = None, 0, []
            for part in (*shared.slices(batches), None):
                if part is not None:
                    keys, endings, first = tokens(part.column("text"))
                    held.append((keys, endings))
                    if sum(len(k) for k, _ in held) < TRAINED_WORDS:
                        continue
                if not held:
                    continue
                if own is None:
                    own = Network.__new__(Network)
                    own.__dict__.update({k: v.copy() for k, v in sent.value.__dict__.items()})
                targets = own.places(np.concatenate([k for k, _ in held]))
                reads = own.inputs(targets, np.concatenate([e for _, e in held]))
                end = own.inputs(own.places(np.array([END_KEY], np.uint64)), np.zeros(1, np.int32))
                before = np.concatenate((end, reads[:-1]))
                is_end = np.concatenate([k for k, _ in held]) == END_KEY
                fresh = np.concatenate(([True], is_end[:-1]))
                own.train(before, fresh, targets)
                words += len(targets)
                held = []
            if own is not None:
                flat = own.weights().astype(np.float64) * words
                part_id = TaskContext.get().partitionId()
                pieces = [flat[i : i + _SLICE].tobytes() for i in range(0, len(flat), _SLICE)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(np.full(len(pieces), part_id, np.int32)),
                    pa.array(np.full(len(pieces), float(words))), pa.array(pieces, pa.binary()),
                ], names=schema.names)

        rows = sorted(_averaged(chosen.select("text").mapInArrow(learn, schema)), key=lambda r: r["slice"])
        if rows:
            network.set_weights(np.concatenate([np.frombuffer(r["total"], np.float64) / r["words"] for r in rows]))
    return network


def report(docs: DataFrame, vocabulary: int = VOCABULARY, share: float = SHARE) -> DataFrame:
    """One row per document with both scores, in powers of ten."""
    chunks = chunked(docs)
    named = vocabularies(chunks)
    counts = shared.cut(named.groupBy("key").agg(F.sum("n").alias("c")), "counts")
    known = counts.where("c > 0")
    train_tokens, distinct = (int(x or 0) for x in known.agg(F.sum("c"), F.count("*")).first())
    end = int(np.array([END_KEY]).view(np.int64)[0])
    top = known.where(F.col("key") != end).orderBy(F.desc("c"), "key").limit(vocabulary - 2).collect()
    end_count = known.where(F.col("key") == end).select("c").first()
    keys = np.array([end, *(r["key"] for r in top)], np.int64).view(np.uint64)
    own = np.array([end_count[0] if end_count else 0, *(r["c"] for r in top)], float)
    all_mass = train_tokens + distinct + 1.0
    mass = max(1.0, all_mass - float((own + 1).sum()))
    network = train(chunks, Network(keys, own, max(0.0, train_tokens - own.sum())), share)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    found = named.join(counts, "key").select("chunk", "key", "c")
    schema = shared.fields(("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        net = sent.value
        all_keys, count = words["key"].to_numpy().view(np.uint64), words["c"].to_numpy()
        base = np.log10((count + 1.0) / all_mass)
        place = net.places(all_keys)
        keys, endings, bounds = [], [], [np.zeros(1, np.int64)]
        for part in shared.slices(iter(texts.select(["text"]).to_batches())):
            own, tail, first = tokens(part.column("text"))
            keys.append(own)
            endings.append(tail)
            bounds.append(first[1:] + bounds[-1][-1])
        if not keys:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        # One look for the whole chunk: the table of hashes is made anew for each.
        at, endings, bounds = _looked_up(np.concatenate(keys), all_keys), np.concatenate(endings), np.concatenate(bounds)
        begin = bounds[:-1]
        targets = place[at]
        reads = net.inputs(targets, endings)
        before = np.empty_like(reads)
        before[1:] = reads[:-1]
        before[begin] = net.inputs(net.places(np.array([END_KEY], np.uint64)), np.zeros(1, np.int32))[0]
        handed = np.where(targets == 0, base[at] - math.log10(mass / all_mass), 0.0)
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": pa.array(~texts["learned"].combine_chunks().to_numpy(zero_copy_only=False)),
            "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(np.add.reduceat((count > 0)[at].astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(len(begin), train_tokens)), "base_score": pa.array(np.add.reduceat(base[at], begin)),
            "score": pa.array(net.score(before, targets, bounds) / math.log(10) + np.add.reduceat(handed, begin)),
        })

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, schema)
