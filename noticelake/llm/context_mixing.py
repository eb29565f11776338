"""Language-model scoring by logistic mixing of context bit predictors.

A text's bytes, A to Z lower-cased, and an end symbol are spelt as the bits of a prefix code, one for each
byte before, so that likely bytes take few steps. For every bit each of several contexts - the last three bytes, the last
five, and the word so far - together with the place in the code names a slot, whose counts of zeros and ones
over the training documents give a prediction. A mixer adds these and the code's own prediction in the logistic
domain, with weights from a set that is gated by how often the contexts have been met, and a map refines the
mixed probability by the gate and its confidence. Training leaves such weights and a map; from the weights come several
mixers, of other confidence or with more trust in one context. Within each document a second layer mixes the mixers
online: every STEP symbols their shares move by how well each of them did. So a document's score depends on its
text and the model alone, not on where it lies.

Slots are exact at every size: a context's bytes and the place in the code fit 64 bits. No worker holds all of
them. Documents are written in chunks, which tasks read again by name, so texts are never shuffled. A chunk
sends each distinct pair of context and symbol once, with its count, to the pair's range of contexts. There the
sums over all chunks become predictions, and each chunk gets those that it asked for. Word counts for the base score
go the same way.

All that a bit's prediction depends on are its symbol and the six bytes before it, a unit. Units repeat, so
predictions are joined and each mixer's cost is formed once for each distinct unit of a chunk. Predictions are oriented:
a positive logit speaks for the bit that came, so turning the bit turns every sign, and the two outcomes'
probabilities sum to one.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.shared import crc32_of_id, documents, read_file, shared_dir, stored, text_or_empty, write_file

#: Bytes that a context looks back; 0 stands for the word so far, of which the last LOOK_BACK bytes count.
CONTEXTS = (3, 5, 0)
LOOK_BACK = 6
#: Stands beside the contexts for the words of the base score.
WORDS = len(CONTEXTS)
#: Bytes of text after which a chunk is closed, and symbols whose units are sorted at a time.
CHUNK_BYTES, BLOCK_SYMBOLS = 14_000_000, 6_000_000
#: Bytes of text for each range of contexts, and ranges at least and at most.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 64_000_000, 32, 65_535
END = 256
#: How many symbols of the whole training text count towards the code after each byte.
PRIOR = 16.0
#: A prediction's byte holds the logit times SCALE in the upper six bits; the lower two say whether the slot
#: has been met never, up to twice, up to sixteen times or more, and these together gate the weights.
SCALE, LARGEST = 4.0, 31
GATES = 4 ** len(CONTEXTS)
INPUTS = len(CONTEXTS) + 1
#: Levels of confidence of the map, half a logit each.
LEVELS = 17
#: The mixers, each a multiple of the trained mix and of one input besides: the trained one, a softer and a sharper one, and
#: one that trusts each context more.
MIXERS = ((1.0, None), (0.7, None), (1.4, None), *((0.7, k) for k in range(len(CONTEXTS))))
EXTRA = 0.3
#: Symbols after which the mixers' shares move in a text; the share of the trained one at its start; what flows back to the start.
STEP, TRAINED_SHARE, FLOW = 32, 0.6, 0.02
#: Symbols whose costs are looked up at a time.
LOOK_UP = STEP * 8192
#: Units met so often lie side by side.
OFTEN = 8
#: Newton steps of a chunk's weights, and the pull towards their first values.
NEWTON_STEPS, RIDGE, FIRST_WEIGHT = 3, 30.0, 0.4

#: Bits whose sums are formed at a time.
BLOCK_BITS = 1 << 15

LEAD = b" " * (LOOK_BACK + 1)
CONTEXT_BITS = 8 * LOOK_BACK
CONTEXT_MASK = np.uint64((1 << CONTEXT_BITS) - 1)
SYMBOL_MASK = np.uint64(0x1FF << CONTEXT_BITS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def lowered(text: str) -> bytes:
    """UTF-8 with A to Z in lower case."""
    return text.encode("utf-8").lower()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one after the other."""
    stops = np.cumsum(lengths, dtype=np.int64)
    out = np.repeat(starts - (stops - lengths), lengths)
    out += np.arange(len(out))
    return out


def huffman(weights: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """For each symbol its way from the root of a Huffman tree: inner nodes, the bit taken at each, and its logit by the weights."""
    heap = [(w, s, s) for s, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    children: list[tuple[tuple, tuple]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a, b))
        heapq.heappush(heap, (a[0] + b[0], END + len(children), END + len(children)))
    paths: dict[int, list[tuple[int, int, float]]] = {heap[0][2]: []}
    for node in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[node]):
            odds = float(np.log(child[0] / children[node][1 - bit][0]))
            paths[child[2]] = [*paths[END + 1 + node], (node, bit, odds)]
    return [paths[s] for s in range(END + 1)]


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each symbol follows each byte, by place in a prefix code; a text follows a space."""
    counts = np.zeros((256, END + 1), np.int64)
    raw = np.frombuffer(b"".join([b" " + t for t in texts]), np.uint8)
    for a in range(0, len(raw) - 1, 1 << 20):
        part = raw[a : a + (1 << 20) + 1]
        counts[:, :END] += np.bincount(part[:-1].astype(np.intp) << 8 | part[1:], minlength=1 << 16).reshape(256, 256)
    lasts = np.array([t[-1] if t else 32 for t in texts], np.intp)
    np.subtract.at(counts, (lasts[:-1], 32), 1)  # the next text's space
    np.add.at(counts, (lasts, END), 1)
    return counts.ravel()


class PrefixCode:
    """Huffman codes of 256 bytes and the end symbol by the byte before; an inner node is the place in a code.

    ``counts`` has a row for each byte before. Bytes before that were never met share a code. ``prior``
    holds what the counts themselves say of each bit, as a logit times SCALE.
    """

    def __init__(self, counts: np.ndarray):
        whole = counts.sum(axis=0) + 1.0
        met = np.flatnonzero(counts.sum(axis=1))
        trees = [huffman(whole), *(huffman(counts[k] + whole * (PRIOR / whole.sum())) for k in met)]
        tree_of = np.zeros(256, np.intp)
        tree_of[met] = np.arange(1, len(trees))
        lengths = np.array([[len(p) for p in tree] for tree in trees], np.int64)
        starts = (np.cumsum(lengths) - lengths.ravel()).reshape(lengths.shape)
        # by the byte before, then the symbol
        self.length, self.start = lengths[tree_of].ravel(), starts[tree_of].ravel()
        steps = [step for tree in trees for p in tree for step in p]
        self.node = np.array([s[0] for s in steps], np.uint8)
        self.bit = np.array([s[1] for s in steps], np.uint8)
        self.prior = np.clip(np.rint(np.array([s[2] for s in steps]) * SCALE), -127, 127).astype(np.int8)


def code_places(keys: np.ndarray) -> np.ndarray:
    """The byte before and the symbol of units, as places in a prefix code."""
    before = keys >> np.uint64(CONTEXT_BITS - 8) & np.uint64(255)
    return (before * np.uint64(END + 1) + (keys >> np.uint64(CONTEXT_BITS))).astype(np.intp)


def windows(raw: np.ndarray) -> np.ndarray:
    """A view of each byte from the eighth on with the seven before it."""
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - LOOK_BACK - 1, LOOK_BACK + 2), (1, 1))


def unit_keys(seen: np.ndarray) -> np.ndarray:
    """Units of windows: the symbol in the upper bits, below it the byte before, then the one before that, and so on.

    So units in order are in order of all their contexts as well.
    """
    w = np.array(seen, order="C").view("<u8").ravel()
    keys = w >> np.uint64(56)
    keys <<= np.uint64(CONTEXT_BITS)
    w >>= np.uint64(8)
    w &= CONTEXT_MASK
    keys |= w
    return keys


def with_ends(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Makes the symbol at some places, in place, the end."""
    keys[ends] = keys[ends] & CONTEXT_MASK | np.uint64(END << CONTEXT_BITS)
    return keys


def keys_of(pieces: list[tuple[bytes, bytes, bool]]) -> np.ndarray:
    """The units of pieces of texts: the bytes that lead up to each, its own, and whether the text ends there."""
    sizes = np.array([len(body) + ends for _, body, ends in pieces], np.int64)
    raw = np.frombuffer(b"".join([lead + body + b"\0" * ends for lead, body, ends in pieces]), np.uint8)
    keys = unit_keys(windows(raw))
    if len(pieces) > 1:
        inside = np.ones(len(keys), bool)
        stops = np.cumsum(sizes + len(LEAD))[:-1] - len(LEAD)
        inside[(stops[:, None] + np.arange(len(LEAD))).ravel()] = False
        keys = keys[inside]
    return with_ends(keys, (np.cumsum(sizes) - 1)[np.array([ends for *_, ends in pieces])])


def key_blocks(texts: Iterable[bytes], size: int = BLOCK_SYMBOLS) -> Iterator[np.ndarray]:
    """The units of some texts, about ``size`` at a time; longer texts go over several blocks and keep their contexts."""
    held, n = [], 0
    for t in texts:
        for a in range(0, len(t) + 1, size):
            lead = (LEAD + t[max(0, a - len(LEAD)) : a])[-len(LEAD) :]
            held.append((lead, t[a : a + size], a + size > len(t)))
            n += len(held[-1][1]) + 1
            if n >= size:
                yield keys_of(held)
                held, n = [], 0
    if held:
        yield keys_of(held)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in an ordered array."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct_units(texts: list[bytes], flags: list[bool], size: int = BLOCK_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct units of some texts in order, and how often the texts that are not held out have each."""
    parts, counts = [], []
    for held_out in (False, True):
        for keys in key_blocks((t for t, flag in zip(texts, flags, strict=True) if flag == held_out), size):
            keys.sort()
            at = firsts(keys)
            parts.append(keys[at])
            counts.append(np.diff(at, append=len(keys)) * (not held_out))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0], counts[0]
    keys, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")  # few ordered runs
    keys = keys[order]
    at = firsts(keys)
    return keys[at], np.add.reduceat(n[order], at)


def context_keys(keys: np.ndarray) -> Iterator[np.ndarray]:
    """By context the units cut to the bytes that it sees; they stay in order."""
    for k in CONTEXTS:
        if k:
            yield keys & np.uint64(-(1 << 8 * (LOOK_BACK - k)) & (1 << 64) - 1)
        else:
            mask = np.full(len(keys), SYMBOL_MASK)
            alive = np.ones(len(keys), bool)
            for j in range(LOOK_BACK):
                low = np.uint64(CONTEXT_BITS - 8 * (j + 1))
                word = (keys >> low & np.uint64(255)) > 32
                if j:
                    alive &= word
                mask |= alive.astype(np.uint64) * (np.uint64(255) << low)
                alive &= word  # of what stands between words the last byte counts
            yield keys & mask


def mixed_up(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose upper bits depend on all."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def dealt(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ordered keys by their contexts' range, then the key; and where each range starts and the last ends."""
    part = (mixed_up(keys & CONTEXT_MASK) % np.uint64(ranges)).astype(np.uint16)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))])


def packed(values: np.ndarray) -> bytes:
    import pyarrow as pa

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def predictions(came: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What a slot's counts say for the bit that came, as a byte."""
    value = np.clip(np.rint(np.log((came + 0.4) / (other + 0.4)) * SCALE), -LARGEST, LARGEST).astype(np.int8)
    met = came + other
    kind = (met > 0).astype(np.int8) + (met > 2) + (met > 16)
    return value << np.int8(2) | kind


class Units:
    """Distinct units with what is predicted for their bits. ``answers`` has the predictions by context and range, for each distinct key in order.

    Of each unit ``first`` and ``length`` say where its bits are. Of each bit ``values`` has the logits times SCALE of all
    contexts and of the code, and ``gate`` its gate.
    """

    def __init__(self, keys: np.ndarray, code: PrefixCode, answers: dict[tuple[int, int], bytes], ranges: int):
        self.keys = keys
        places = code_places(keys)
        self.length = code.length.take(places)
        self.first = np.cumsum(self.length) - self.length
        n = int(self.length.sum())
        self.values, self.gate = np.empty((INPUTS, n), np.int8), np.zeros(n, np.uint8)
        for c, own in enumerate(context_keys(keys)):
            at = firsts(own)
            order, cuts = dealt(own[at], ranges)
            lengths = code.length.take(code_places(own[at][order]))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            parts = [unpacked(answers[c, r], int(ends[cuts[r + 1]] - ends[cuts[r]]), np.int8) for r in np.flatnonzero(np.diff(cuts)).tolist()]
            begin = np.empty(len(at), np.int64)
            begin[order] = ends[:-1]
            found = np.concatenate([np.zeros(0, np.int8), *parts]).take(spans(np.repeat(begin, np.diff(at, append=len(keys))), self.length))
            np.right_shift(found, np.int8(2), out=self.values[c])
            self.gate |= (found & np.int8(3)).view(np.uint8) << np.uint8(2 * c)
        self.values[-1] = code.prior.take(spans(code.start.take(places), self.length))


class Finder:
    """Numbers distinct keys in the order in which they are given, by an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, (2 * len(keys)).bit_length()))
        self.table = np.full(1 << int(np.uint64(64) - self.shift), -1, np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        home = self.homes(keys)
        while len(rest):
            free = self.table[home] < 0
            self.table[home[free]] = rest[free]
            lost = self.table[home] != rest
            rest, home = rest[lost], (home[lost] + 1) & (len(self.table) - 1)

    def homes(self, keys: np.ndarray) -> np.ndarray:
        return (mixed_up(keys) >> self.shift).astype(np.intp)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of some keys, all of which must be among these."""
        home = self.homes(keys)
        found = self.table.take(home)
        wrong = np.flatnonzero(self.keys.take(found) != keys)
        while len(wrong):
            home[wrong] = (home[wrong] + 1) & (len(self.table) - 1)
            found[wrong] = self.table[home[wrong]]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return found


class Model:
    """The mixer's weights and the map that training left."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, INPUTS), FIRST_WEIGHT / SCALE, np.float32)
        self.map = np.tile(sigmoid(np.arange(LEVELS, dtype=np.float32) / 2 + np.float32(0.25)), (GATES, 1))

    def mixed(self, values: np.ndarray, gate: np.ndarray) -> np.ndarray:
        mix = np.zeros(len(gate), np.float32)
        for k in range(INPUTS):
            mix += values[k] * self.weights[:, k].take(gate)
        return mix

    @staticmethod
    def level(mix: np.ndarray) -> np.ndarray:
        out = np.abs(mix)
        out *= np.float32(2)
        return np.minimum(out, np.float32(LEVELS - 1), out=out).astype(np.intp)

    def learn(self, units: Units, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets the weights by Newton's method over units met so often; returns the bits of each gate and the map's hits and rights."""
        met = np.zeros(GATES, np.int64)
        here = np.flatnonzero(counts)
        bits = spans(units.first[here], units.length[here])
        weight = np.repeat(counts[here].astype(np.float32), units.length[here])
        order = np.argsort(units.gate.take(bits), kind="stable")
        bits, weight = bits[order], weight[order]
        cuts = np.searchsorted(units.gate.take(bits), np.arange(GATES + 1))
        mix = np.empty(len(bits), np.float32)
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            start, stop = int(cuts[g]), int(cuts[g + 1])
            met[g] = int(weight[start:stop].sum())
            blocks = [slice(a, min(a + BLOCK_BITS, stop)) for a in range(start, stop, BLOCK_BITS)]
            seen = [units.values[:, bits[b]] for b in blocks]
            own = np.full(INPUTS, FIRST_WEIGHT)
            for _ in range(NEWTON_STEPS):
                slope, bend = RIDGE * (FIRST_WEIGHT - own), RIDGE * np.eye(INPUTS)
                for b, values in zip(blocks, seen, strict=True):
                    x = values * np.float32(1 / SCALE)
                    p = sigmoid(own.astype(np.float32) @ x)
                    wrong = np.float32(1) - p
                    wrong *= weight[b]
                    slope += x @ wrong
                    p *= wrong
                    bend += (x * p) @ x.T
                step = np.linalg.solve(bend, slope)
                own += step * min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
            self.weights[g] = own / SCALE
            for b, values in zip(blocks, seen, strict=True):
                mix[b] = self.weights[g] @ values.astype(np.float32)
        cell = np.repeat(np.arange(GATES) * LEVELS, np.diff(cuts))
        cell += self.level(mix)
        hits = np.bincount(cell, weights=weight, minlength=GATES * LEVELS)
        rights = np.bincount(cell, weights=weight * (1 + np.sign(mix)) / 2, minlength=GATES * LEVELS)
        return met, hits, rights

    def unit_costs(self, units: Units) -> np.ndarray:
        """By unit and mixer the natural logarithm of the symbol's probability."""
        out = np.empty((len(units.keys), len(MIXERS)), np.float32)
        refining = self.map.ravel()
        for a in range(0, len(units.keys), BLOCK_BITS // 4):
            first = units.first[a : a + BLOCK_BITS // 4]
            bits = slice(int(first[0]), int(first[-1] + units.length[a + len(first) - 1]))
            values, gate = units.values[:, bits], units.gate[bits].astype(np.intp)
            trained = self.mixed(values, gate)
            gate *= LEVELS
            for j, (share, k) in enumerate(MIXERS):
                mix = trained * np.float32(share)
                if k is not None:
                    mix += values[k] * np.float32(EXTRA / SCALE)
                # the map's probability of the bit that came; of no opinion, a half
                refined = refining.take(gate + self.level(mix))
                refined -= np.float32(0.5)
                refined *= np.sign(mix)
                refined += np.float32(0.5)
                refined += sigmoid(mix)
                refined *= np.float32(0.5)
                out[a : a + len(first), j] = np.add.reduceat(np.log(np.maximum(refined, np.float32(1e-6), out=refined), out=refined), first - first[0])
        return out

    def scores(self, texts: list[bytes], units: Units, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text and its end.

        The first STEP symbols of each text have the shares of mixers that all texts start with; those after them have
        what the text itself has taught. Texts do not see each other. ``counts`` of the units, of whatever texts, only
        set where they lie in memory.
        """
        by_length = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        often = np.concatenate([np.flatnonzero(counts >= OFTEN), np.flatnonzero(counts < OFTEN)])  # near each other in memory
        costs = np.append(self.unit_costs(units)[often], np.zeros((1, len(MIXERS)), np.float32), axis=0)
        sums = step_sums([texts[i] for i in by_length], Finder(units.keys[often]), costs)
        steps = np.array([-(-(len(texts[i]) + 1) // STEP) for i in by_length])
        first = np.cumsum(steps) - steps
        start = np.full(len(MIXERS), (1 - TRAINED_SHARE) / (len(MIXERS) - 1))
        start[0] = TRAINED_SHARE
        shares, whole = np.tile(start, (len(texts), 1)), np.zeros(len(texts))
        for s in range(int(steps[0])):
            n = int(np.searchsorted(-steps, -s))
            cost = sums[first[:n] + s].astype(np.float64)
            top = cost.max(axis=1, keepdims=True)
            gained = shares[:n] * np.exp(cost - top)
            total = gained.sum(axis=1, keepdims=True)
            whole[:n] += (top + np.log(total))[:, 0]
            shares[:n] = gained * ((1 - FLOW) / total) + start * FLOW
        out = np.empty(len(texts))
        out[by_length] = whole / np.log(10)
        return out


def step_sums(texts: list[bytes], units: Finder, costs: np.ndarray) -> np.ndarray:
    """The costs of each step of each text, text after text, by mixer. A last row of ``costs`` stands for no symbol."""
    ones, out = np.ones((1, STEP), np.float32), []

    def add(keys: np.ndarray, sizes: np.ndarray) -> None:
        steps = -(-sizes // STEP)
        filled = np.full(int(steps.sum()) * STEP, len(units.keys), np.intp)
        filled[spans((np.cumsum(steps) - steps) * STEP, sizes)] = units.find(keys)
        out.append((ones @ costs.take(filled, axis=0).reshape(-1, STEP, costs.shape[1]))[:, 0])

    held, size = [], 0
    for t in [*texts, None]:
        if held and (t is None or size >= LOOK_UP):
            if len(held) == 1:
                for keys in key_blocks(held, LOOK_UP):
                    add(keys, np.array([len(keys)]))
            else:
                add(next(key_blocks(held, 2 * size + len(held))), np.array([len(x) + 1 for x in held]))
            held, size = [], 0
        if t is not None:
            held.append(t)
            size += len(t) + 1
    return np.concatenate(out)


def is_held_out(column: str) -> Column:
    return F.coalesce(crc32_of_id(column) % 5 == 1, F.lit(False))


def write_chunks(rows: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the rows of doc_id, held_out, text in chunks and returns a list of them: chunk (its name), its rows and
    training rows, its bytes of text, and how often each symbol follows each byte in its training texts.

    A chunk closes once it has ``chunk_bytes`` of text. A task that is run again writes other names; only
    those in the list count.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            texts, flags = [h[2] for h in held], [h[1] for h in held]
            counts = pair_counts([t for t, flag in zip(texts, flags, strict=True) if not flag])
            types = [pa.int64(), pa.bool_(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], ["doc_id", "held_out", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            name = f"{uuid.uuid4().hex}.arrow"
            write_file(folder, name, sink.getvalue())
            at = np.flatnonzero(counts)
            values = [name, len(held), flags.count(False), sum(map(len, texts)), at.tolist(), counts[at].tolist()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["chunk", "n", "n_training", "size", "places", "counts"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((row[0], row[1], lowered(row[2])))
                size += len(held[-1][2])
                if size >= chunk_bytes:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    schema = "chunk string, n long, n_training long, size long, places array<long>, counts array<long>"
    return stored(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema), "chunks")


def read_chunk(folder: str, name: str) -> tuple[list[bytes], list, list[bool]]:
    """A chunk's texts, their ids and whether held out."""
    import pyarrow as pa

    table = pa.ipc.open_file(pa.py_buffer(read_file(folder, name))).read_all()
    return table["text"].to_pylist(), table["doc_id"].to_pylist(), table["held_out"].to_pylist()


def write_units(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Keeps a chunk's units; a task that is run again writes the same."""
    parts = [packed(np.diff(keys, prepend=np.uint64(0))), packed(counts.astype(np.uint32))]
    write_file(folder, f"{name}.units", b"".join([len(keys).to_bytes(8, "little"), len(parts[0]).to_bytes(8, "little"), *parts]))


def read_units(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    data = read_file(folder, f"{name}.units")
    n, size = (int.from_bytes(data[a : a + 8], "little") for a in (0, 8))
    return np.cumsum(unpacked(data[16 : 16 + size], n, np.uint64)), unpacked(data[16 + size :], n, np.uint32).astype(np.int64)


def all_pair_counts(chunks: DataFrame) -> np.ndarray:
    """How often each symbol follows each byte in the training texts; 65,792 sums at most come to the driver."""
    counts = np.zeros(256 * (END + 1), np.int64)
    pairs = chunks.select(F.explode(F.arrays_zip("places", "counts")).alias("e")).groupBy("e.places").agg(F.sum("e.counts").alias("n"))
    for place, n in pairs.collect():
        counts[place] = n
    return counts.reshape(256, END + 1)


def words_of(texts: list[bytes]):
    """The words of some texts: each word's number in text order, the distinct words in order of first use, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    trimmed = pc.ascii_trim_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(trimmed), 0), None, trimmed))
    coded = split.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist(), sizes


def parts_of_words(words: list[bytes], ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the words of each range."""
    part = np.fromiter((zlib.crc32(w) % ranges for w in words), np.uint16, len(words))
    order = np.argsort(part, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))])
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, order[cuts[r] : cuts[r + 1]]


def one_task_each(chunks: DataFrame) -> DataFrame:
    """The chunks' names, dealt over about as many tasks."""
    return chunks.select("chunk").repartition(max(1, min(chunks.count(), 10_000)))


ANSWERS = "chunk string, context int, part int, whole binary, without binary, n long, v long"


def predictions_of(chunks: DataFrame, folder: str, code, ranges: int) -> DataFrame:
    """chunk, context, part and the predictions that the chunk needs of this range of contexts.

    ``whole`` comes from the counts of all training texts; ``without`` leaves out one meeting of the context with
    the symbol itself, as for a text that has it and is not among those counted. For WORDS ``whole`` has the
    words' counts. One row for each range of words, with an empty chunk, has how many words the
    training texts have there (n) and how many different ones (v).
    """

    def ask(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                texts, _, flags = read_chunk(folder, name)
                out = []
                used, words, sizes = words_of(texts)
                counts = np.bincount(used[np.repeat(~np.array(flags), sizes)], minlength=len(words)).astype(np.uint32)
                for r, some in parts_of_words(words, ranges):
                    body = b" ".join([words[i] for i in some.tolist()])
                    size = len(body).to_bytes(8, "little")
                    out.append((WORDS, r, len(some), size + pa.compress(body, codec="zstd", asbytes=True), packed(counts[some])))
                del used, words
                keys, n = distinct_units(texts, flags)
                write_units(folder, name, keys, n)
                for c, own in enumerate(context_keys(keys)):
                    at = firsts(own)
                    order, cuts = dealt(own[at], ranges)
                    distinct, counts = own[at][order], np.add.reduceat(n, at)[order].astype(np.uint32)
                    for r in np.flatnonzero(np.diff(cuts)).tolist():
                        part = slice(int(cuts[r]), int(cuts[r + 1]))
                        steps = np.diff(distinct[part], prepend=np.uint64(0))
                        out.append((c, r, part.stop - part.start, packed(steps), packed(counts[part])))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), *columns], ["chunk", "context", "part", "n", "keys", "counts"])

    def table_of(table, part: int, whole: list, without: list, n: int | None = None, v: int | None = None):
        import pyarrow as pa

        extra = [] if n is None else [""]
        names, rows = table["chunk"].to_pylist() + extra, len(whole) + len(extra)
        context = table["context"][0].as_py()
        return pa.table({
            "chunk": pa.array(names), "context": pa.array([context] * rows, pa.int32()), "part": pa.array([part] * rows, pa.int32()),
            "whole": pa.array([*whole, *(None for _ in extra)], pa.binary()), "without": pa.array([*without, *(None for _ in extra)], pa.binary()),
            "n": pa.array([None] * len(whole) + [n for _ in extra], pa.int64()), "v": pa.array([None] * len(whole) + [v for _ in extra], pa.int64()),
        })

    def answer_words(part: int, table):
        import pyarrow as pa

        asked, sums = [], Counter()
        for blob, n, counts in zip(table["keys"].to_pylist(), table["n"].to_pylist(), table["counts"].to_pylist(), strict=True):
            body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
            asked.append(body.split(b" "))
            for word, count in zip(asked[-1], unpacked(counts, n, np.uint32).tolist(), strict=True):
                sums[word] += count
        whole = [packed(np.fromiter(map(sums.__getitem__, some), np.uint64, len(some))) for some in asked]
        return table_of(table, part, whole, [None] * len(whole), sum(sums.values()), sum(s > 0 for s in sums.values()))

    def answer(key, table):
        if key[0].as_py() == WORDS:
            return answer_words(key[1].as_py(), table)
        spelling = code.value
        sizes = table["n"].to_pylist()
        asked = [np.cumsum(unpacked(x, n, np.uint64)) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)]
        counts = [unpacked(x, n, np.uint32) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)]
        distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        places = code_places(distinct)
        lengths = spelling.length.take(places)
        starts = np.cumsum(lengths) - lengths
        spelt = spans(spelling.start.take(places), lengths)
        contexts = np.repeat((distinct & CONTEXT_MASK) << np.uint64(8), lengths)
        slots, slot = np.unique(contexts | spelling.node.take(spelt), return_inverse=True)
        bit = spelling.bit.take(spelt)
        sums = np.bincount(2 * slot + bit, weights=np.repeat(total, lengths), minlength=2 * len(slots)).astype(np.int64)
        came, other = sums[2 * slot + bit], sums[2 * slot + 1 - bit]
        by_bit = predictions(came, other), predictions(np.maximum(came - 1, 0), other)
        whole, without, stop = [], [], 0
        for n in sizes:
            start, stop = stop, stop + n
            mine = at[start:stop]
            bits = spans(starts[mine], lengths[mine])
            whole.append(packed(by_bit[0].take(bits)))
            without.append(packed(by_bit[1].take(bits)))
        return table_of(table, key[1].as_py(), whole, without)

    requests = one_task_each(chunks).mapInArrow(ask, "chunk string, context int, part int, n long, keys binary, counts binary")
    return requests.groupBy("context", "part").applyInArrow(answer, ANSWERS)


def fit(found: DataFrame, folder: str, code, ranges: int) -> tuple[Model, int, int]:
    """The model of all training texts, and how many words they have, and how many different ones.

    Each chunk finds weights for its units, as often as it has met them, by what is predicted without them. The
    weights are averaged by how many bits each gate has met, and the map's hits are added. What is predicted
    for the chunk's scores is kept beside its texts.
    """
    model = Model()
    cells = GATES * (INPUTS + 1) + 2 * model.map.size

    def work(key, table):
        import pyarrow as pa

        name = key[0].as_py()
        if not name:  # numbers of words
            sums = np.array([sum(table[c].to_pylist()) for c in ("n", "v")], np.float64)
            return pa.table({"place": pa.array([cells, cells + 1]), "value": pa.array(sums)})
        write_answers(folder, name, table)
        keys, counts = read_units(folder, name)
        columns = zip(table["context"].to_pylist(), table["part"].to_pylist(), table["without"].to_pylist(), strict=True)
        units = Units(keys, code.value, {(c, r): a for c, r, a in columns}, ranges)
        own = Model()
        met, hits, rights = own.learn(units, counts)
        values = np.concatenate([(own.weights * met[:, None]).ravel(), met, hits, rights]).astype(np.float64)
        at = np.flatnonzero(values)
        return pa.table({"place": pa.array(at), "value": pa.array(values[at])})

    learnt = stored(found.groupBy("chunk").applyInArrow(work, "place long, value double"), "learnt")
    sums = np.zeros(cells + 2)
    for r in learnt.groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[r.place] = r.value
    weights, met, hits, rights, words = np.split(sums, np.cumsum([GATES * INPUTS, GATES, model.map.size, model.map.size]))
    seen = met > 0
    model.weights[seen] = weights.reshape(GATES, INPUTS)[seen] / met[seen, None]
    model.map = ((model.map.ravel() * 20 + rights) / (hits + 20)).astype(np.float32).reshape(model.map.shape)
    return model, int(words[0]), int(words[1])


def write_answers(folder: str, name: str, table) -> None:
    import pyarrow as pa

    kept = table.select(["context", "part", "whole"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, kept.schema) as out:
        out.write_table(kept)
    write_file(folder, f"{name}.answers", sink.getvalue())


def read_answers(folder: str, name: str) -> dict[tuple[int, int], bytes]:
    """By context and range what is predicted for a chunk from all training texts."""
    import pyarrow as pa

    table = pa.ipc.open_file(pa.py_buffer(read_file(folder, f"{name}.answers"))).read_all()
    return {(c, r): a for c, r, a in zip(*(table[k].to_pylist() for k in ("context", "part", "whole")), strict=True)}


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Counts and the model come from the documents that are not held out. ``score`` is log10 of the
    probability of the text's bytes and its end; ``bits_per_byte`` is the same in bits, for each byte and the end. A null
    text counts as empty; a null id is in the training part; repeated rows are scored each; an empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn(
        "held_out", held_out
    )
    folder = shared_dir(spark, "scored-texts")
    chunks = write_chunks(rows, folder)
    about = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n_training"), F.lit(0)).alias("ends")).first()
    ends, ranges = int(about.ends), min(MOST_RANGES, max(LEAST_RANGES, int(about["size"]) // RANGE_BYTES))
    code = spark.sparkContext.broadcast(PrefixCode(all_pair_counts(chunks)))
    model, n, v = fit(predictions_of(chunks, folder, code, ranges), folder, code, ranges)
    n, v = n + ends, v + (ends > 0)
    bottom = n + 0.5 * (v + 1)
    end_score = float(np.log10((ends + 0.5) / bottom))
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            texts, ids, flags = read_chunk(folder, name)
            answers = read_answers(folder, name)
            used, words, sizes = words_of(texts)
            counts = np.zeros(len(words), np.uint64)
            for r, some in parts_of_words(words, ranges):
                counts[some] = unpacked(answers[WORDS, r], len(some), np.uint64)
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]

            def by_text(values: np.ndarray) -> np.ndarray:
                sums = np.zeros(len(texts), values.dtype)
                if len(filled):
                    sums[filled] = np.add.reduceat(values.take(used), starts)
                return sums

            base = by_text(np.log10((counts + 0.5) / bottom)) + end_score
            known = by_text((counts > 0).astype(np.int64)) + (ends > 0)
            del used, words
            keys, met = read_units(folder, name)
            scores = shared.value.scores(texts, Units(keys, code.value, answers, ranges), met)
            rows = len(texts)
            columns = {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(flags, pa.bool_()),
                "n_tokens": pa.array(sizes + 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n] * rows, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores, pa.float64()),
                "bits_per_byte": pa.array(-scores * np.log2(10) / np.array([len(t) + 1 for t in texts]), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "bits_per_byte double"
    )
    return one_task_each(chunks).mapInArrow(work, schema)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a fifth of them, by the crc32 of their ids, are held out of the model."""
    return score_documents(documents(spark, sf_dir), is_held_out("doc_id"))
