"""SentencePiece text to ids and back: unigram Viterbi over a double-array trie of pieces.

The model file gives the pieces, their log scores and the byte pieces. Blanks become the marker U+2581, with one marker
before the text; the best-scoring segmentation is found by dynamic programming over all pieces that the trie finds at
each character; characters without a piece of their own are scored below every piece and written as byte pieces.
Decoding puts bytes together, turns markers back into blanks and takes the first one away.

No piece holds a marker behind another character (this is checked), so a text falls apart before each run of markers and
each part has its own best segmentation. Parts are looked up in a bounded memory; the new ones of a batch are segmented
together, all trie steps and all Viterbi steps at once in numpy. The trie and its scores have the size of the
vocabulary and travel by broadcast; texts are not shuffled.

Defined cases: null and empty texts have no ids and decode to the empty text. A text that holds the marker itself decodes
to one with blanks there; ``round_trip`` compares with that. Of equally good segmentations the one whose last piece
starts first wins, then the one before it in turn. Repeated rows, null keys and extra columns are carried; a column
that has the name of a new one is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefold.llm.common import short_batches
from sitefold.llm.words import ranges, text_bytes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Log score of a character without a piece, below the lowest score of a piece.
UNKNOWN_PENALTY = 10.0
#: Parts kept in a task's memory, and their bytes, before it starts afresh.
MEMORY_PARTS, MEMORY_BYTES = 200_000, 32 << 20
_NORMAL, _BYTE, _USER = 1, 6, 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """Piece, score and kind of every id of a model file."""
    with open(path, "rb") as file:
        data = file.read()
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1], struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
    return pieces


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value of a trie over the keys: from state s by byte b to base[s] + b, if check there is s.

    States are placed breadth first, each at the first base where all its children find free cells.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for value, key in enumerate(keys):
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][b]
        ends[node] = value
    size = 4 * len(children) + 8192
    base, check, values = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[:257], values[0], state = True, ends[0], {0: 0}  # no base is below zero
    free_from, queue = 257, [0]
    for node in queue:
        own = children[node]
        if not own:
            continue
        offsets = np.fromiter(own, np.int64)
        offsets -= offsets[0]
        window = free_from
        while True:
            free = window + np.flatnonzero(~used[window : window + 2048])
            free = free[free + offsets.min() > 256]
            fits = np.flatnonzero(~used[free[:, None] + offsets].any(axis=1)) if len(offsets) > 1 else np.zeros(min(1, len(free)), int)
            if len(fits):
                break
            window += 2048
        at = int(free[fits[0]]) - next(iter(own))
        base[state[node]] = at
        for b, child in own.items():
            used[at + b], check[at + b], values[at + b] = True, state[node], ends[child]
            state[child] = at + b
            queue.append(child)
        free_from += int(np.argmin(used[free_from : free_from + 4096]))
    last = int(np.flatnonzero(used)[-1]) + 257
    return base[:last], check[:last], values[:last]


class Vocabulary:
    """Trie, scores and byte pieces of a model."""

    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        marker = MARKER.encode()
        chosen = [i for i, (_, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER)]
        for i in chosen:
            if marker in pieces[i][0].lstrip(marker):
                raise ValueError(f"piece {i} holds the blank marker behind another character")
        self.ids = np.array(chosen, np.int32)
        self.base, self.check, self.values = double_array([pieces[i][0] for i in chosen])
        self.scores = np.array([pieces[i][1] for i in chosen])
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        surfaces = []
        for piece, _, kind in pieces:
            if kind == _BYTE:
                surfaces.append(bytes([int(piece[1:-1], 16)]))
            else:
                surfaces.append(piece.replace(marker, b" ") if kind in (_NORMAL, _USER) else b"")
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_end = np.cumsum([len(x) for x in surfaces])
        self.surface_size = np.array([len(x) for x in surfaces])

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and how many each has."""
        sizes = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(sizes)
        is_start = (data & 0xC0) != 0x80
        is_start[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(is_start)
        part = np.searchsorted(ends, starts, side="right")
        limit = ends[part]
        following = np.r_[starts[1:], len(data)]
        # All trie steps: states of all starts that still follow some piece.
        edge_from, edge_to, edge_piece = [], [], []
        alive, state, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts.copy()
        single = np.zeros(len(starts), bool)
        while len(alive):
            inside = at < limit[alive]
            alive, state, at = alive[inside], state[inside], at[inside]
            target = self.base[state] + data[at].astype(np.int64)
            good = self.check[target] == state
            alive, state, at = alive[good], target[good], at[good] + 1
            value = self.values[state]
            hit = np.flatnonzero(value >= 0)
            edge_from.append(alive[hit])
            edge_to.append(at[hit])
            edge_piece.append(value[hit])
            single[alive[hit][at[hit] == following[alive[hit]]]] = True
        lone = np.flatnonzero(~single)
        edge_from.append(lone)
        edge_to.append(following[lone])
        edge_piece.append(np.full(len(lone), -1))
        begin, end, piece = map(np.concatenate, (edge_from, edge_to, edge_piece))
        score = np.where(piece >= 0, self.scores[piece], self.unknown)
        # Viterbi: in step k the k-th character of every part passes its best score on.
        first = np.searchsorted(starts, ends - sizes)
        step = np.arange(len(starts)) - first[part]
        order = np.argsort(step[begin], kind="stable")
        begin, end, piece, score = begin[order], end[order], piece[order], score[order]
        cuts = np.searchsorted(step[begin], np.arange(int(step.max()) + 2 if len(step) else 1))
        best = np.full(len(data) + 1, -np.inf)
        came_from, came_by = np.zeros(len(data) + 1, np.int64), np.full(len(data) + 1, -1)
        origin = starts[begin]
        # A position is the end of one part and the start of the next: scores of starts are kept apart.
        reached = np.full(len(starts), -np.inf)
        reached[step == 0] = 0.0
        start_at = np.full(len(data) + 1, -1)
        start_at[starts] = np.arange(len(starts))
        limit_of = limit
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            source, target = begin[a:b], end[a:b]
            value = reached[source] + score[a:b]
            better = value > best[target]
            t = target[better]
            best[t], came_from[t], came_by[t] = value[better], origin[a:b][better], piece[a:b][better]
            inner = t[t < limit_of[source[better]]]
            reached[start_at[inner]] = best[inner]
        # Walk back from all ends at once and mark where pieces end.
        marked = np.zeros(len(data) + 1, bool)
        at, low = ends[sizes > 0], (ends - sizes)[sizes > 0]
        while len(at):
            marked[at] = True
            at = came_from[at]
            more = at > low
            at, low = at[more], low[more]
        stops = np.flatnonzero(marked)
        owner = np.searchsorted(ends, stops, side="left")
        by = came_by[stops]
        width = np.where(by < 0, stops - came_from[stops], 1)
        ids = np.repeat(np.where(by >= 0, self.ids[by], -1), width)
        place = np.repeat(came_from[stops], width) + ranges(width)
        lost = ids < 0
        ids[lost] = self.byte_ids[data[place[lost]]]
        return ids.astype(np.int32), np.bincount(np.repeat(owner, width), minlength=len(parts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        width = self.surface_size[ids]
        data = self.surface[np.repeat(self.surface_end[ids] - width, width) + ranges(width)].tobytes()
        ends = np.r_[0, np.cumsum(width)][np.cumsum(counts)]
        texts, begin = [], 0
        for end in ends.tolist():
            own = data[begin:end]
            texts.append((own[1:] if own[:1] == b" " else own).decode("utf-8", "replace"))
            begin = end
        return texts


def parts_of(text: str) -> list[str]:
    """Parts that begin with a run of markers and hold no other marker."""
    words = text.replace(" ", MARKER).split(MARKER)
    if "" not in words:
        return [MARKER + w for w in words]
    parts, run = [], 0
    for word in words:
        run += 1
        if word:
            parts.append(MARKER * run + word)
            run = 0
    return parts + [MARKER * run] if run else parts


class Encoder:
    """Encodes batches and remembers the parts it has segmented."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY_PARTS):
        self.vocabulary, self.memory = vocabulary, memory
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.number) > self.memory or self.bytes > MEMORY_BYTES:
            self._forget()
        number, parts, counts = self.number, [], []
        for text in texts:
            own = parts_of(text) if text else []
            parts += own
            counts.append(len(own))
        fresh = [p for p in dict.fromkeys(parts) if p not in number]
        if fresh:
            own = [p.encode() for p in fresh]
            self.bytes += sum(map(len, own))
            ids, sizes = self.vocabulary.segment(own)
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(sizes) - sizes]
            self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, sizes]
        at = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        width = self.size[at]
        ids = self.ids[np.repeat(self.begin[at], width) + ranges(width)]
        text = np.repeat(np.arange(len(texts)), counts)
        return ids, np.bincount(text, width, len(texts)).astype(np.int64)


def load(path: str = MODEL_PATH) -> Vocabulary:
    return Vocabulary(read_pieces(path))


def encode(docs: DataFrame, text: str = "text", path: str = MODEL_PATH, decoded: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``.

    ``decoded`` names a column for the decoded text, if it is wanted.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    docs = docs.drop("token_ids", "n_tokens", "round_trip", *([decoded] if decoded else []))
    at = docs.columns.index(text)
    added = ["token_ids array<int>", "n_tokens bigint", "round_trip boolean", *([f"`{decoded}` string"] if decoded else [])]

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            rows = batch.num_rows
            sizes = np.diff(text_bytes(batch.column(at))[1])
            group = np.cumsum(sizes) // (1 << 20)
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, rows]
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if first == last:
                    continue
                own = batch.slice(first, last - first)
                texts = own.column(at).to_pylist()
                ids, counts = encoder.encode(texts)
                back = encoder.vocabulary.decode(ids, counts)
                same = [b == (t or "").replace(MARKER, " ") for b, t in zip(back, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                columns = [*own.columns, lists, pa.array(counts), pa.array(same)]
                names = [*own.schema.names, "token_ids", "n_tokens", "round_trip"]
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return short_batches(docs).mapInArrow(run, ", ".join([fields, *added]))


def decode(rows: DataFrame, ids: str = "token_ids", path: str = MODEL_PATH, decoded: str = "decoded") -> DataFrame:
    """All rows and columns with the text of their ids; null ids give a null text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(path))
    rows = rows.drop(decoded)
    at = rows.columns.index(ids)

    def run(batches):
        for batch in batches:
            lists = batch.column(at).to_pylist()
            flat = np.array([i for own in lists for i in own or []], np.int64)
            texts = vocabulary.value.decode(flat, np.array([len(own or []) for own in lists], np.int64))
            texts = [None if own is None else t for own, t in zip(lists, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return short_batches(rows).mapInArrow(run, f"{fields}, `{decoded}` string")

