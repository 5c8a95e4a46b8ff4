"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is read from a model file (its path is a parameter; its bytes go to the tasks as one
broadcast, whose size is the file's). The search runs over the lattice of pieces: a position holds the
best piece that ends there and so the boundary before it. For a unigram model the best path has the
largest sum of scores. For a merge (BPE) model a path is allowed if every neighbouring pair of pieces
stays as it is when the two alone are merged by the model's priorities; then exactly one path reaches
each position, the one merging yields, and scores need no comparison.

Only a window is kept: a later piece can start no further back than the longest piece, so the
backpointer paths of those positions are followed until they meet, and the ids before the boundary
where they meet are committed. Between characters that no piece spans (before a space mark, at
characters outside the vocabulary) all paths meet by construction; the stretches between such places
are encoded one by one and remembered in a bounded memo.

Cases: null text has null ids; the empty text has none; characters outside the vocabulary become byte
pieces (or the unknown id, if the model has no bytes); decoding gives the text back, except that the
mark U+2581 itself comes back as a space and unknown ids as the unknown mark; invalid ids raise.
Models with a normalisation table are refused. Repeated rows are encoded alike; an empty table gives
an empty result.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import text_slices

MARK = "▁"                            # fixed value: stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)   # fixed values: kinds of pieces
UNIGRAM, BPE = 1, 2                        # fixed values: kinds of models
UNKNOWN_COST = 10.0                        # below the smallest score, as for any unigram model
MEMO = 600_000
LONGEST_KEPT = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message: varints, fixed 32 bits as float, byte strings."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            yield tag >> 3, data[at:at + 8]
            at += 8


class Vocabulary:
    """Pieces of a model file, and its encoder and decoder."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.dummy_prefix, extra, table = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                table, self.dummy_prefix, extra = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if table or extra:
            raise ValueError("models that normalise text or drop extra spaces are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        self.score = {p: s for p, s, k in zip(self.pieces, scores, kinds) if k in (NORMAL, USER)}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (NORMAL, USER)}
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.score.values(), default=0.0) - UNKNOWN_COST
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
                    else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}     # the memo before, dropped when the new one is full
        self.pairs: dict[int, bool] = {}
        if self.kind == BPE:                # pieces that merging never yields are no pieces of a path
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merged(p) == [p]}
        # Suffix tree of the pieces, read backwards from a position. Characters that only occur inside longer
        # pieces get numbers of their own after the pieces' ids; in a path they become byte pieces.
        self.names = list(self.pieces)
        inside = {c for p in self.ids for c in p} - set(self.ids)
        self.names.extend(sorted(inside))
        self.suffixes: dict = {}
        for p, i in [*self.ids.items(), *((c, len(self.pieces) + n) for n, c in enumerate(sorted(inside)))]:
            node = self.suffixes
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[0] = i
        self.neighbours = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._cut = self._stretches()

    def _stretches(self):
        """Pattern of the stretches no piece reaches across, or None if pieces hold a mark after other characters."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return None
        alphabet = {c for p in self.ids for c in p}
        outside = "".join(re.escape(c) for c in "\n\t" if c not in alphabet)
        return re.compile(f"{MARK}+[^{MARK}{outside}]*|[^{MARK}{outside}]+" + (f"|[{outside}]+" if outside else ""))

    def _merged(self, s: str) -> list[str]:
        """The pieces of a short string by merging: best score first, leftmost among equals."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging the two neighbours alone leaves them as they are."""
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = \
            self._merged(self.names[left] + self.names[right]) == [self.names[left], self.names[right]]
        return known

    def _stream(self, s: str) -> list[int]:
        """Ids of ``s``, committed as soon as the paths meet; the window kept starts at ``base``."""
        longest, bpe, root, pairs, size = self.longest, self.kind == BPE, self.suffixes, self.pairs.get, len(s)
        out: list[int] = []
        base = 0                                      # boundary all paths go through
        start, last, best = [0], [-1], [0.0]          # of the path that ends at base + i: its last piece
        check = 2 * longest
        for end in range(1, size + 1):
            node, at, found = root, end, []
            while at > base:
                at -= 1
                node = node.get(s[at])
                if node is None:
                    break
                if 0 in node:
                    found.append((at, node[0]))
            begin, chosen, top = end - 1, -1, None    # -1: a character outside the vocabulary, anything may follow
            if bpe:
                for at, piece in reversed(found):     # longest first; exactly one is allowed
                    left = last[at - base]
                    if left < 0:
                        ok = True
                    else:
                        ok = pairs(left << 32 | piece)
                        if ok is None:
                            ok = self._stays(left, piece)
                    if ok:
                        begin, chosen = at, piece
                        break
            else:
                for at, piece in found:
                    v = best[at - base] + (self.score[self.names[piece]] if piece < len(self.pieces) else self.floor)
                    if top is None or v > top:
                        top, begin, chosen = v, at, piece
                if not found or found[0][0] < end - 1:
                    v = best[end - 1 - base] + self.floor
                    if top is None or v > top:
                        top, begin, chosen = v, end - 1, -1
                best.append(top)
            start.append(begin)
            last.append(chosen)
            if end == check or end == size:
                live = {end} if end == size else set(range(max(base, end - longest + 1), end + 1))
                while len(live) > 1:                  # the furthest path steps back until all meet
                    far = max(live)
                    live.remove(far)
                    live.add(start[far - base])
                meet = live.pop()
                path, at = [], meet
                while at > base:
                    path.append((start[at - base], at))
                    at = start[at - base]
                for a, b in reversed(path):
                    piece = last[b - base]
                    if 0 <= piece < len(self.pieces):
                        out.append(piece)
                    elif self.bytes:
                        out.extend(self.bytes[x] for x in s[a:b].encode())
                    else:
                        out.append(self.unknown)
                if meet > base:                       # the piece before the boundary stays: it limits what may follow
                    start, last, best = start[meet - base:], last[meet - base:], best[meet - base:]
                    base = meet
                check = end + longest
        return out

    def _encode_stretch(self, s: str) -> tuple[int, ...]:
        found = self.memo.get(s) or self.older.get(s)
        if found is None and len(s) <= LONGEST_KEPT:
            for i in range(len(s) - 1, 0, -1):        # no piece holds these two characters: all paths meet between them
                if s[i - 1:i + 1] not in self.neighbours:
                    found = self._encode_stretch(s[:i]) + self._encode_stretch(s[i:])
                    break
        if found is None:
            found = tuple(self._stream(s))
        if len(s) <= LONGEST_KEPT:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[s] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        s = text.replace(" ", MARK)
        if self.dummy_prefix:
            s = MARK + s
        if self._cut is None:
            return self._stream(s)
        out: list[int] = []
        known, extend = self.memo.get, out.extend
        for stretch in self._cut.findall(s):
            extend(known(stretch) or self._encode_stretch(stretch))
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _loaded(model) -> Vocabulary:
    """The vocabulary of a broadcast model, made once per worker process (with its memo) and kept on the broadcast."""
    if not hasattr(model, "vocabulary"):
        model.vocabulary = Vocabulary(model.value)
        gc.freeze()
    return model.vocabulary


def encode(docs: DataFrame, text_col: str = "text", model_path: str | None = None, out_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``, the ids of each whole text, and with ``decoded_col`` the text decoded from those ids
    (in the same task, so the ids do not travel twice)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path or default_model()))
    keep = [c for c in docs.columns if c not in (out_col, decoded_col)]
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        v = _loaded(model)
        for b in batches:
            for part in text_slices([b], 4 << 20, b.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                flat, ends = array("i"), [0]
                gc.disable()                          # the memo's tuples hold no cycles; scanning them again and again is dear
                try:
                    for t in texts:
                        flat.extend(v.encode(t or ""))
                        ends.append(len(flat))
                finally:
                    gc.enable()
                missing = pa.array([t is None for t in texts] + [False]) if None in texts else None
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing.to_numpy(zero_copy_only=False)) if missing is not None
                                               else pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
                more, names = [], [*keep, out_col]
                if decoded_col:
                    more = [pa.array([None if t is None else v.decode(flat[x:y]) for t, x, y in zip(texts, ends, ends[1:])], pa.string())]
                    names.append(decoded_col)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *more], names=names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, `{out_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))


def decode(rows: DataFrame, ids_col: str = "ids", model_path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``, the text of the ids."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(model_path or default_model()))
    keep = [c for c in rows.columns if c != out_col]
    at = keep.index(ids_col)

    def run(batches):
        v = _loaded(model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                col = part.column(at)
                flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_pylist()
                texts = [v.decode(flat[x:y].tolist()) if ok else None
                         for x, y, ok in zip(offsets, offsets[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, out_col])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out_col)
    return rows.mapInArrow(run, f"{schema}, `{out_col}` string")
