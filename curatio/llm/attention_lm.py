"""Language-model scores: a causal self-attention model trained in numpy on subword ids, beside a word base.

One pass over the texts (in slices of a task's rows) gathers everything the corpus gives: per slice and
word a row with its training count and its postings, counts of subwords and of neighbouring pairs, and
the training documents cut into consecutive windows of subword ids, each subword the target of one position.
Word counts are summed and joined back to the postings, so the base score needs no vocabulary in memory; a word
of all documents is one row per slice.

Model: every subword of the training corpus has a slot of its own; those that never occur in it, which it cannot
tell apart, share the rest. Counts of neighbouring pairs over the whole training corpus, held as one entry per
different pair, give each slot's smoothed followers, an embedding (leading factors of their log ratios) and one
of ``CLASSES`` output classes (clusters of embeddings). One causal attention layer with learned
distance biases reads the embeddings and corrects the class probabilities the pair counts give; a subword's
probability is its class's times its share, by the pair counts, of the class. Every partition trains a copy of
the layer on its windows (Adam, batch by batch) and the copies are averaged, ``ROUNDS`` times; only weights travel.
Equal windows of a slice are rows with weights up to ``SPREAD``, dealt out apart from each other.

Scoring reads the texts once more: documents are cut into overlapping windows of ``CONTEXT`` + ``STRIDE``
positions; a window scores its last ``STRIDE`` positions, so each token is scored once, and all windows of
a slice go through masked attention together. The score adds up log10 over all subwords and the end mark.

Cases: null text counts as empty (its one token is the end); texts of any length are scored whole; a null
key counts as the empty text for the split the caller makes; repeated rows get equal scores and count each
as a document; without training documents all counts are 0 and all subwords are equally likely; an empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices
from curatio.llm.sentencepiece_codec import default_model, read_model

CONTEXT, STRIDE = 8, 24
LENGTH = CONTEXT + STRIDE
SLOTS, CLASSES, WIDTH = 2048, 128, 16      # slots of subwords at least (up to here pairs are looked up in a table), output classes, embedding
ROUNDS, BATCH, RATE = 3, 64, 0.01
CHUNK = 64                                   # windows scored at a time, few enough to stay in a core's cache
HIDDEN = np.float32(-60)                     # a masked key's weight is exp(-60) at most
PULL = 3.0                                   # weight of the single counts in the smoothed pair counts
SLICE = 4 << 20
MEMO = 400_000                               # words remembered by a worker
PAIRS = 500_000                              # different pairs summed by a task before they go out
SPREAD = 16                                  # equal windows of a slice that go as one row with a weight
PACK = 8                                     # bits for the count in a posting
DOC, WORD, SUBWORD, PAIR, WINDOW = range(5)


class Words:
    """Numbers and subword ids of the words met so far; starts anew beyond ``MEMO`` words."""

    def __init__(self, processor):
        self.processor = processor
        self.clear()

    def clear(self):
        self.ids: dict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.n = np.zeros(0, dtype=np.int64)                     # subwords of each word
        self.pieces = np.zeros(0, dtype=np.int32)                # of all words, one after the other
        self.hashes = np.zeros(0, dtype=np.uint64)

    def learn(self):
        """Subwords and hashes of the words that came since the last call."""
        new = list(islice(self.ids, len(self.n), None))
        if new:
            gc.disable()                                         # many small lists and no cycles: nothing to collect
            found = self.processor.encode([w.decode() for w in new], num_threads=1)
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            pieces = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(n.sum()))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
            self.n, self.pieces = np.append(self.n, n), np.append(self.pieces, pieces)
            self.hashes = np.append(self.hashes, hashes)
            gc.enable()
        self.start = np.cumsum(self.n) - self.n


class Tokens:
    """Words and subwords of a slice of texts, as flat arrays; word numbers are the slice's own."""

    def __init__(self, texts: list[str | None], words: Words):
        if len(words.ids) > MEMO:
            words.clear()
        flat, sizes = [], []
        number = words.ids.__getitem__
        for t in texts:
            w = (t or "").encode().lower().split()           # bytes: A-Z only, ASCII blanks only
            sizes.append(len(w))
            flat.extend(map(number, w))
        words.learn()
        memo = np.array(flat, dtype=np.int64)
        seen = np.zeros(len(words.n), dtype=bool)
        seen[memo] = True
        own = np.flatnonzero(seen)
        self.word = (np.cumsum(seen) - 1)[memo]              # word number of each token, ends left out
        self.hashes = words.hashes[own]
        self.n_words = np.array(sizes, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.n_pieces = words.n[own]
        ends = np.cumsum(self.n_pieces)
        self.piece_start = ends - self.n_pieces
        total = int(ends[-1]) if len(ends) else 0
        self.pieces = words.pieces[np.arange(total) + np.repeat(words.start[own] - self.piece_start, self.n_pieces)]

    def subwords(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first place of each text) of all subwords, each text closed by ``end``."""
        n = self.n_pieces[self.word]
        ends = np.cumsum(n)
        source = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.piece_start[self.word], n)
        body = self.pieces[source]
        total = np.concatenate([[0], ends])[np.cumsum(self.n_words)] if len(self.n_words) else np.zeros(0, dtype=np.int64)
        out = np.insert(body, total, end)
        size = np.diff(np.concatenate([[0], total])) + 1
        return out.astype(np.int32), np.cumsum(size) - size


def _words(model) -> Words:
    """The tokenizer of a broadcast model and its memo, made once per worker process and kept on the broadcast."""
    if not hasattr(model, "words"):
        import sentencepiece
        model.words = Words(sentencepiece.SentencePieceProcessor(model_proto=model.value))
    return model.words


def _kind(n_pieces: int) -> np.dtype:
    """The number type of a subword id in a window."""
    return np.dtype(np.uint16 if n_pieces <= 1 << 16 else np.int32)


def _windows(ids: np.ndarray, first: np.ndarray, learn: np.ndarray, end: int, n_pieces: int) -> pa.Array:
    """The texts with ``learn`` cut into windows of LENGTH + 1 subwords that share their border: the end mark stands
    before each text, and every subword of a text is the target of one position."""
    size = np.diff(np.append(first, len(ids)))
    n = np.where(learn, -(-size // LENGTH), 0)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(LENGTH, np.repeat(size, n) - k * LENGTH) + 1
    ends = np.cumsum(width)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.repeat(first, n) + k * LENGTH - ends + width, width)
    flat = np.concatenate([[end], ids])[at].astype(_kind(n_pieces))      # texts are closed by the end: it stands before the next one
    offsets = (np.concatenate([[0], ends]) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _weighted(windows: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(windows, weights, part): equal ones as rows of a weight up to SPREAD; ``part`` numbers the rows of a window."""
    found = windows.value_counts()
    count = found.field("counts").to_numpy().astype(np.int64)
    rows = -(-count // SPREAD)
    which = np.repeat(np.arange(len(count)), rows)
    part = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
    return found.field("values").take(pa.array(which)), count[which] // rows[which] + (part < count[which] % rows[which]), part


def _gather(batches: Iterator[pa.RecordBatch], model, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, held, text) -> rows (slice, kind, h, n, items, id, held, window) of the kinds above."""
    words = _words(model)
    end = words.processor.eos_id()
    task = TaskContext.get()
    own, done = task.partitionId() if task else 0, 0

    def rows(slice_id, what, h, n, items=None, ids=None, held=None, window=None):
        k = len(h)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, slice_id)), pa.array(np.full(k, what, dtype=np.int32)), pa.array(h), pa.array(n),
             items if items is not None else pa.nulls(k, pa.list_(pa.int32())),
             ids if ids is not None else pa.nulls(k, kind), held if held is not None else pa.nulls(k, pa.bool_()),
             window if window is not None else pa.nulls(k, pa.binary())],
            names=["slice", "kind", "h", "n", "items", "id", "held", "window"])

    pairs, pair_counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)    # summed over slices
    for b in text_slices(batches, SLICE):
        texts = b.column("text").to_pylist()
        held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
        slice_id, done = np.int64(own << 32 | done), done + 1     # no other slice's, whatever the rows hold
        t = Tokens(texts, words)
        docs = len(texts)
        crc = np.array([zlib.crc32((x or "").encode()) for x in texts], dtype=np.uint32).view(np.int32)
        yield rows(slice_id, DOC, np.arange(docs), t.n_words + 1, pa.ListArray.from_arrays(
            pa.array(np.arange(docs + 1, dtype=np.int32)), pa.array(crc)), b.column("id"), b.column("held"))

        # Postings: (word, document) pairs with counts; a count over 255 takes several entries.
        word = np.concatenate([t.word, np.full(docs, len(t.hashes))])                 # the end is the last word
        pair, count = np.unique(word * docs + np.concatenate([t.doc, np.arange(docs)]), return_counts=True)
        extra = np.repeat(np.arange(len(pair)), (count - 1) // 255 + 1)
        step = np.minimum(255, count[extra] - 255 * (np.arange(len(extra)) - np.searchsorted(extra, extra)))
        which, doc = pair[extra] // docs, pair[extra] % docs
        trained = np.bincount(which, weights=step * ~held[doc], minlength=len(t.hashes) + 1).astype(np.int64)
        offsets = np.searchsorted(which, np.arange(len(t.hashes) + 2)).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array((doc << PACK | step).astype(np.int32)))
        h = np.append(t.hashes, np.uint64(xxhash.xxh3_64_intdigest(b"\n")))          # no word holds a line end
        yield rows(slice_id, WORD, h.view(np.int64), trained, items)

        # Subwords and neighbouring pairs, counted by word: inside words from the word counts, between words by token.
        weight = np.repeat(trained[:-1], t.n_pieces)
        n = np.bincount(t.pieces, weights=weight, minlength=end + 1).astype(np.int64)
        n[end] += trained[-1]
        seen = np.flatnonzero(n)
        yield rows(slice_id, SUBWORD, seen.astype(np.int64), n[seen])
        inner = np.ones(len(t.pieces), dtype=bool)
        inner[t.piece_start] = False
        head, tail = np.append(t.pieces[t.piece_start], end), np.append(t.pieces[t.piece_start + t.n_pieces - 1], end)
        seq = np.insert(t.word, np.cumsum(t.n_words), len(t.hashes))                  # with an end after each text
        before = np.concatenate([[len(t.hashes)], seq[:-1]])
        learn = ~np.repeat(held, t.n_words + 1)
        outer, k = np.unique(tail[before[learn]].astype(np.int64) << 20 | head[seq[learn]], return_counts=True)
        at = np.flatnonzero(inner & (weight > 0))
        pairs, where = np.unique(np.concatenate([pairs, outer, t.pieces[at - 1].astype(np.int64) << 20 | t.pieces[at]]), return_inverse=True)
        pair_counts = np.bincount(where, weights=np.concatenate([pair_counts, k, weight[at]]), minlength=len(pairs)).astype(np.int64)
        if len(pairs) > PAIRS:
            yield rows(slice_id, PAIR, pairs, pair_counts)
            pairs, pair_counts = pairs[:0], pair_counts[:0]
        ids, first = t.subwords(end)
        windows, weights, part = _weighted(_windows(ids, first, ~held, end, words.processor.get_piece_size()))
        if len(windows):
            yield rows(slice_id, WINDOW, part, weights, window=windows)
    if len(pairs):
        yield rows(np.int64(0), PAIR, pairs, pair_counts)


class Model:
    """Pair statistics, classes and the attention layer's weights ``w``."""

    def __init__(self, counts: np.ndarray, pairs, end: int):
        """``counts`` of each subword id in the training corpus; ``pairs(slot)`` gives the counts of neighbouring slots:
        a matrix, or arrays of first slots, second slots and counts with each pair once."""
        order = [end] + [i for i in np.argsort(-counts, kind="stable").tolist() if i != end]
        self.end = end
        seen = int(np.count_nonzero(counts)) + (counts[end] == 0)
        self.slots = max(SLOTS, int(seen))
        self.slot = np.full(len(counts), self.slots, dtype=np.int32)
        self.slot[order[:self.slots]] = np.arange(min(self.slots, len(order)))
        mass = np.bincount(self.slot, weights=counts + 0.5, minlength=self.slots + 1)
        self.share = np.where(self.slot == self.slots, np.log((counts + 0.5) / max(mass[self.slots], 0.5)), 0).astype(np.float32)
        single = np.maximum(mass / mass.sum(), 1e-30)                       # slots without ids have no mass
        found = pairs(self.slot)
        x, y, n = found if isinstance(found, tuple) else (*np.nonzero(found), found[np.nonzero(found)])
        key = x.astype(np.int64) * (self.slots + 1) + y
        order = np.argsort(key)
        self.key, x, y, n = key[order], x[order], y[order], np.asarray(n, dtype=np.float64)[order]
        after = np.bincount(x, weights=n, minlength=self.slots + 1)
        # log follow(x, y) = log((n + PULL single y) / (after x + PULL)): a part of x, a part of y, and a gain where n > 0
        self.by_x, self.by_y = -np.log(after + PULL).astype(np.float32), np.log(PULL * single).astype(np.float32)
        self.gain = np.log1p(n / (PULL * single[y])).astype(np.float32)
        self.table = None
        if self.slots == SLOTS:
            self.table = np.zeros((SLOTS + 1) ** 2, dtype=np.float32)
            self.table[self.key] = self.gain
        rng = np.random.default_rng(8)
        # The log ratio of the joint counts n + 0.1 N single x single y is likewise a part of x, one of y, and one where n > 0.
        pull = 0.1 * max(n.sum(), 1e-3)
        more = np.log1p(n / (pull * single[x] * single[y]))
        part_x = np.log(single * pull / (after + pull * single)) + np.log(n.sum() + pull)
        part_y = np.log(single / (np.bincount(y, weights=n, minlength=self.slots + 1) + pull * single))
        weight = np.sqrt(np.minimum(1, mass / (mass.mean() + 1e-9)))[:, None]

        def spread(i, j, v):
            return np.stack([np.bincount(i, weights=more * v[j, k], minlength=self.slots + 1) for k in range(v.shape[1])], axis=1)

        def followed(v):                                                    # the weighted ratio times v
            return weight * (spread(x, y, v) + part_x[:, None] * v.sum(axis=0) + part_y @ v)

        def preceded(v):                                                    # its transpose times v
            v = weight * v
            return spread(y, x, v) + part_x @ v + part_y[:, None] * v.sum(axis=0)
        left = rng.standard_normal((self.slots + 1, WIDTH))
        for _ in range(8):                                                  # subspace iteration
            left, _ = np.linalg.qr(followed(preceded(left)))
        right = preceded(left)
        self.embed = np.concatenate([left, right / (np.linalg.norm(right, axis=0) + 1e-6)], axis=1)
        self.embed = (self.embed / (self.embed.std(axis=0) + 1e-6)).astype(np.float32)[:, :2 * WIDTH]
        self.of = self._clusters(self.embed, mass, rng)
        near = np.bincount(x.astype(np.int64) * CLASSES + self.of[y], weights=n, minlength=(self.slots + 1) * CLASSES).reshape(-1, CLASSES)
        near = near + PULL * np.bincount(self.of, weights=single, minlength=CLASSES)
        self.prior = np.log(near / (after + PULL)[:, None] + 1e-30).astype(np.float32)        # log p(class | slot before)
        d = 2 * WIDTH
        small = lambda *s: (rng.standard_normal(s) * 0.05).astype(np.float32)
        self.w = {"Q": small(d, WIDTH), "K": small(d, WIDTH), "V": small(d, WIDTH), "S": small(d, WIDTH),
                  "D": np.zeros(LENGTH, dtype=np.float32), "O": np.zeros((WIDTH, CLASSES), dtype=np.float32),
                  "B": np.zeros(CLASSES, dtype=np.float32)}

    @staticmethod
    def _clusters(x: np.ndarray, mass: np.ndarray, rng) -> np.ndarray:
        """Nearest of ``CLASSES`` centres; the most frequent slots are the first centres."""
        centre = x[np.argsort(-mass, kind="stable")[:CLASSES]].copy()
        for _ in range(10):
            of = np.argmin((centre ** 2).sum(axis=1) - 2 * x @ centre.T, axis=1)
            for c in range(CLASSES):
                own = of == c
                if own.any():
                    centre[c] = np.average(x[own], axis=0, weights=np.maximum(mass[own], 1e-6))   # slots without ids have no mass
        return of.astype(np.int32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = np.asarray(flat[at:at + n], dtype=np.float32).reshape(self.w[k].shape)
            at += n

    def follow(self, prev: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log p(slot | slot before) by the smoothed pair counts."""
        key = prev.astype(np.int64) * (self.slots + 1) + slot
        if self.table is not None:
            gain = self.table[key]
        elif len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            gain = np.where(self.key[at] == key, self.gain[at], np.float32(0))
        else:
            gain = np.float32(0)
        return self.by_x[prev] + self.by_y[slot] + gain

    def tables(self, own=slice(None)) -> dict[str, np.ndarray]:
        """What the embedding of every slot (or of the slots ``own``) turns into, so that a position is a lookup."""
        embed = self.embed[own]
        t = {k: embed @ self.w[k] for k in "QKVS"}
        t["Z"] = t["S"] @ self.w["O"] + self.w["B"] + self.prior[own]
        t["Q"] *= np.float32(1 / math.sqrt(WIDTH))
        t["KV"] = np.concatenate([t["K"], t["V"], np.ones((len(embed), 1), dtype=np.float32)], axis=1)   # the ones sum the weights
        return t

    def room(self, name: str, dtype, *shape: int) -> np.ndarray:
        """An array that the last batch of this shape used as well: a new one costs as much time as a pass over it."""
        rooms = self.__dict__.setdefault("rooms", {})
        if name not in rooms or rooms[name].shape != shape or rooms[name].dtype != dtype:
            rooms[name] = np.empty(shape, dtype=dtype)
        return rooms[name]

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows ``at`` of a table."""
        return np.take(table, at, axis=0, out=self.room(name, table.dtype, *at.shape, table.shape[1]), mode="clip")

    def attend(self, q: np.ndarray, kv: np.ndarray, valid: np.ndarray | None = None):
        """Causal attention of the last positions (``q``) over all (``kv``: keys, values and ones): the weights, not
        yet summing to one, their sums, and the values' means."""
        late, n = q.shape[1], kv.shape[1]
        gap = np.arange(n - late, n)[:, None] - np.arange(n)[None, :]
        a = np.matmul(q, kv[:, :, :WIDTH].transpose(0, 2, 1), out=self.room("a", q.dtype, len(q), late, n))
        a += np.where(gap >= 0, self.w["D"][np.abs(gap)], HIDDEN).astype(np.float32)
        if valid is not None and not valid.all():
            some = ~valid.all(axis=1)
            a[some] += np.where(valid[some], np.float32(0), HIDDEN)[:, None, :]
        np.clip(a, HIDDEN, -HIDDEN, out=a)
        np.exp(a, out=a)
        sums = np.matmul(a, kv[:, :, WIDTH:], out=self.room("sums", q.dtype, len(q), late, WIDTH + 1))
        total = sums[:, :, WIDTH:]
        return a, total, np.divide(sums[:, :, :WIDTH], total, out=self.room("o", q.dtype, len(q), late, WIDTH)), gap

    def shifts(self, t: dict[str, np.ndarray], x: np.ndarray, valid: np.ndarray, skip: int = 0) -> np.ndarray:
        """``x`` (windows, positions) slots, ``valid`` keys; what attention adds to the class logits ``t["Z"]`` of the
        slots at the positions from ``skip`` on, one row a position."""
        o = self.attend(self.rows("q", t["Q"], x[:, skip:]), self.rows("kv", t["KV"], x), valid)[2].reshape(-1, WIDTH)
        return np.matmul(o, self.w["O"], out=self.room("z", o.dtype, len(o), CLASSES))

    def forward(self, t: dict[str, np.ndarray], x: np.ndarray, valid: np.ndarray, skip: int = 0):
        """Class logits of the positions from ``skip`` on, and the shifts in them."""
        z = self.shifts(t, x, valid, skip).reshape(len(x), -1, CLASSES)
        return z + np.take(t["Z"], x[:, skip:], axis=0), z

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over valid positions (targets; a window ends with its last one), windows weighted."""
        if "odds" not in self.__dict__:
            self.odds = np.exp(self.prior)
        w, (n, length), flat = self.w, x.shape, x.ravel()
        scale = np.float32(1 / math.sqrt(WIDTH))
        e, kind, d = self.rows("e", self.embed, flat), self.embed.dtype, WIDTH
        # Of every position query, shift, key, value and a one: the ones sum the weights.
        t = self.room("t", kind, len(e), 4 * d + 1)
        np.matmul(e, np.concatenate([w["Q"] * scale, w["S"], w["K"], w["V"]], axis=1), out=t[:, :-1])
        t[:, -1] = 1
        t = t.reshape(n, length, -1)
        q, k, v = t[:, :, :d], t[:, :, 2 * d:3 * d], t[:, :, 3 * d:]
        a, total, o, gap = self.attend(q, t[:, :, 2 * d:])                  # keys after the end are later than all valid positions
        h = self.room("h", kind, n, length, d + 1)
        np.add(t[:, :, d:2 * d], o, out=h[:, :, :d])
        h[:, :, d] = 1
        h = h.reshape(-1, d + 1)
        out = np.concatenate([w["O"], w["B"][None, :]])
        z = np.matmul(h, out, out=self.room("z", kind, len(h), CLASSES))
        # The class probabilities but for their sums.
        if max(z.max(), -z.min()) <= -HIDDEN:
            np.exp(z, out=z)
            z *= self.rows("odds", self.odds, flat)
        else:
            z += np.take(self.prior, flat, axis=0)
            np.exp(z - z.max(axis=1, keepdims=True), out=z)
        sums = z @ np.ones(CLASSES, dtype=kind)
        z.ravel()[np.arange(0, z.size, CLASSES) + self.of[y.ravel()]] -= sums
        mass = valid if weight is None else valid * weight[:, None]
        rate = (mass.ravel() / max(1, mass.sum()) / sums).astype(kind)[:, None]
        dh = np.matmul(z, np.ascontiguousarray(w["O"].T), out=self.room("dh", kind, len(z), d))
        dh *= rate
        h *= rate
        last = h.T @ z
        dh = dh.reshape(n, length, d)
        pull = self.room("pull", kind, n, length, d + 1)
        np.divide(dh, total, out=pull[:, :, :d])
        np.negative(np.einsum("ijk,ijk->ij", pull[:, :, :d], o), out=pull[:, :, d])
        ds = np.matmul(pull, v.transpose(0, 2, 1), out=self.room("ds", kind, n, length, length))
        ds *= a
        g = self.room("g", kind, n, length, 4 * d)                          # of query, shift, key and value
        np.matmul(ds, k, out=g[:, :, :d])
        g[:, :, d:2 * d] = dh
        np.matmul(ds.transpose(0, 2, 1), q, out=g[:, :, 2 * d:3 * d])
        np.matmul(a.transpose(0, 2, 1), pull[:, :, :d], out=g[:, :, 3 * d:])
        each, ok = ds.sum(axis=0), gap >= 0
        parts = e.T @ g.reshape(-1, 4 * d)
        return {"Q": parts[:, :d] * scale, "S": parts[:, d:2 * d], "K": parts[:, 2 * d:3 * d], "V": parts[:, 3 * d:],
                "O": last[:d], "B": last[d], "D": np.bincount(gap[ok], weights=each[ok], minlength=LENGTH).astype(np.float32)}

    def train(self, parts: Iterator[np.ndarray], rate: float = RATE) -> None:
        """One run with Adam over ``parts``, each up to BATCH rows of LENGTH + 1 slots (-1 after the end) and a weight."""
        now = self.flat()
        m, s = np.zeros_like(now), np.zeros_like(now)
        for step, part in enumerate(parts, 1):
            x, y = part[:, :LENGTH], part[:, 1:LENGTH + 1]
            found = self.gradients(np.maximum(x, 0), np.maximum(y, 0), y >= 0, part[:, LENGTH + 1])
            g = np.concatenate([found[k].ravel() for k in sorted(self.w)])
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g ** 2 - s)
            now = now - np.float32(rate) * (m / np.float32(1 - 0.9 ** step)) / (np.sqrt(s / np.float32(1 - 0.99 ** step)) + np.float32(1e-8))
            self.load(now)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text (``ids`` of all texts, each closed by the end; ``first``: their starts)."""
        size = np.diff(np.append(first, len(ids)))
        n = -(-size // STRIDE)
        text = np.repeat(np.arange(len(first)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        before = np.concatenate([[self.end], ids[:-1]])
        before[first] = self.end                                            # what stands before each subword
        slot, prev = self.slot[ids], self.slot[before]
        cls = self.of[slot]
        out = np.zeros(len(ids), dtype=np.float32)
        t = self.tables()
        top = t["Z"].max(axis=1)
        odds = np.exp(t["Z"] - top[:, None])
        for lo in range(0, len(text), CHUNK):
            i, j = text[lo:lo + CHUNK], k[lo:lo + CHUNK]
            rel = (j * STRIDE)[:, None] + np.arange(-CONTEXT, STRIDE)[None, :]
            at = first[i][:, None] + np.clip(rel, 0, size[i][:, None] - 1)
            z = self.shifts(t, prev[at], rel >= 0, CONTEXT)                 # what follows a text is masked as later anyway
            where, ok = at[:, CONTEXT:].ravel(), (rel[:, CONTEXT:] < size[i][:, None]).ravel()
            chosen = z[np.arange(len(z)), cls[where]]
            if max(z.max(), -z.min()) <= -HIDDEN:
                np.exp(z, out=z)
                chosen -= np.log(np.einsum("ij,ij->i", z, self.rows("odds", odds, prev[where])))
            else:
                z += t["Z"][prev[where]] - top[prev[where], None]
                high = z.max(axis=1)
                chosen -= np.log(np.exp(z - high[:, None]).sum(axis=1)) + high
            out[where[ok]] = chosen[ok]
        # the class's part of the slot before, and the subword's share of its class
        out += t["Z"][prev, cls] - top[prev] + self.follow(prev, slot) - self.prior[prev, cls] + self.share[ids]
        return np.add.reduceat(out.astype(np.float64), first) / math.log(10) if len(first) else np.zeros(0)


def _slots(windows: pa.Array, slot: np.ndarray) -> np.ndarray:
    """Rows of LENGTH + 1 slots, -1 after the end."""
    kind = _kind(len(slot))
    ends = np.frombuffer(windows.buffers()[1], dtype=np.int32)[windows.offset:windows.offset + len(windows) + 1] // kind.itemsize
    out = np.full((len(windows), LENGTH + 1), -1, dtype=np.int32)
    out[np.arange(LENGTH + 1) < np.diff(ends)[:, None]] = slot[np.frombuffer(windows.buffers()[2], dtype=kind)[ends[0]:ends[-1]]]
    return out


def _parts(batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The rows of ``batches`` in groups of BATCH; only the last may be smaller."""
    rest = None
    for b in batches:
        b = b if rest is None else np.concatenate([rest, b])
        full = len(b) // BATCH * BATCH
        for lo in range(0, full, BATCH):
            yield b[lo:lo + BATCH]
        rest = b[full:]
    if rest is not None and len(rest):
        yield rest


def fit(gathered: DataFrame, n_pieces: int, end: int, rounds: int = ROUNDS) -> Model:
    """Statistics of the whole training corpus, then ``rounds`` of averaged training on all windows."""
    spark = gathered.sparkSession
    counts = np.zeros(n_pieces)
    for r in gathered.filter(F.col("kind") == SUBWORD).groupBy("h").agg(F.sum("n").alias("n")).collect():   # at most the tokenizer's size
        counts[r["h"]] = r["n"]

    def pairs(slot: np.ndarray) -> np.ndarray:
        """Pair counts of slots; every subword of a pair has its own slot. One row per different pair reaches the driver."""
        rows = gathered.filter(F.col("kind") == PAIR).groupBy("h").agg(F.sum("n").alias("n")).toPandas()
        h = rows["h"].to_numpy(dtype=np.int64)
        return slot[h >> 20], slot[h & (1 << 20) - 1], rows["n"].to_numpy(dtype=np.float64)

    model = Model(counts, pairs, end)
    # Dealt by window, slice and part, so that equal windows spread over all tasks; in an order of its own in each.
    mixed = F.xxhash64("window", "slice", "h")
    windows = gathered.filter(F.col("kind") == WINDOW).select("window", F.col("n").cast("int").alias("n"), mixed.alias("mixed"))
    dealt = stored(windows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mixed")
                   .sortWithinPartitions("mixed", "window", "n").select("window", "n"), "windows")
    fixed = spark.sparkContext.broadcast({k: v for k, v in model.__dict__.items() if k not in ("key", "gain", "table")})   # training needs no pairs
    for _ in range(rounds):
        now = model.flat()

        def local(batches):
            own, seen = Model.__new__(Model), 0
            own.__dict__.update(fixed.value)
            own.w = dict(own.w)
            own.load(now)

            def slots():
                nonlocal seen
                for b in batches:
                    if b.num_rows:
                        n = b.column("n").to_numpy()
                        seen += int(n.sum())
                        yield np.concatenate([_slots(b.column("window"), own.slot), n[:, None]], axis=1)
            own.train(_parts(slots()))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([np.append(own.flat().astype(np.float64) * seen, seen).tolist()],
                                                           pa.list_(pa.float64()))], names=["w"])
        sums = stored(dealt.mapInArrow(local, "w array<double>"), "weights").select(F.posexplode("w")) \
            .groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
        if not sums:
            break
        total = np.array([r["s"] for r in sums])
        model.load(total[:-1] / total[-1])
    return model


def base_scores(gathered: DataFrame) -> tuple[DataFrame, int, int]:
    """(slice, ord, logs, known) per document, and the training corpus's tokens N and distinct tokens V."""
    words = gathered.filter(F.col("kind") == WORD)
    counts = stored(words.groupBy("h").agg(F.sum("n").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    one = words.select("slice", "h", "items").join(counts, "h") \
        .select("slice", "c", F.explode("items").alias("p")) \
        .select("slice", F.shiftright("p", PACK).alias("ord"), "c", F.col("p").bitwiseAND(F.lit((1 << PACK) - 1)).alias("k"))
    sums = one.groupBy("slice", "ord").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"),
                                           F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"))
    return sums, n, v


def score(docs: DataFrame, key: str = "doc_id", text_col: str = "text", held_out=None, model_path: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``held_out`` (a condition)
    names the rows that nothing is learned from."""
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    src = docs.select(F.col(key).alias("id"), held.alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    proto = read_model(model_path or default_model())
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    tokenizer = spark.sparkContext.broadcast(proto)
    id_type = src.schema["id"].dataType
    kind = pa.int64() if id_type.simpleString() == "bigint" else pa.int32() if id_type.simpleString() == "int" else pa.string()
    if pa.types.is_string(kind):
        src = src.withColumn("id", F.col("id").cast("string"))
    gathered = stored(src.mapInArrow(lambda it: _gather(it, tokenizer, kind),
                                     f"slice bigint, kind int, h bigint, n bigint, items array<int>, id {src.schema['id'].dataType.simpleString()}, held boolean, window binary"),
                      "gathered")
    weights = spark.sparkContext.broadcast(fit(gathered, sp.get_piece_size(), sp.eos_id()).__dict__)
    sums, n, v = base_scores(gathered)
    crc = F.get("items", F.lit(0)).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    base = gathered.filter(F.col("kind") == DOC).select("slice", F.col("h").cast("int").alias("ord"), F.col("id").alias("_id"),
                                                        crc.alias("_crc"), F.col("n").alias("n_tokens")) \
        .join(sums, ["slice", "ord"]).groupBy("_id", "_crc") \
        .agg(F.min("n_tokens").alias("n_tokens"), F.min("known").alias("n_known"), F.min("logs").alias("logs"))   # repeated rows are equal

    def run(batches):
        words, m = _words(tokenizer), Model.__new__(Model)
        m.__dict__.update(weights.value)
        for b in text_slices(batches, SLICE // 2):
            ids, first = Tokens(b.column("text").to_pylist(), words).subwords(words.processor.eos_id())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held"), b.column("crc"), pa.array(m.score(ids, first))],
                                             names=["id", "held", "crc", "score"])

    id_name = src.schema["id"].dataType.simpleString()
    scored = src.select("id", "held", F.crc32("text").alias("crc"), "text").mapInArrow(
        run, f"id {id_name}, held boolean, crc bigint, score double")
    joined = scored.join(base, F.col("id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")))
    return joined.select(F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", F.col("n_known").cast("bigint").alias("n_known"),
                         F.lit(int(n)).cast("bigint").alias("train_tokens"),
                         (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), "score")
