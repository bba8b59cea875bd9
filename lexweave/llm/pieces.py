"""SentencePiece encoding and decoding by shared-prefix dynamic programming.

White space becomes the mark U+2581 and texts are cut into marked words, across which no piece reaches. Each batch's
distinct words are sorted, which is depth-first order in their trie; the forward table (one entry per prefix) of a word is
kept for the next one as far as their common prefix goes.

Unigram models: the entry of a prefix is its best score and the length of the last piece (Viterbi). BPE models have no
additive score, so Viterbi on their piece scores would give other ids than the library's. There the entry is the last
piece of the prefix's merge result, which is unique: the piece t that is a merge result by itself and for which merging
the last piece before t together with t leaves both apart. Ids equal the library's in both cases.

Edge cases: a null text gives null ids, an empty one no ids. Characters without a piece fall back to their UTF-8 bytes if
the model has byte pieces, else to the unknown id. Texts that hold U+2581 decode to a space in its place, as in the
library. No shuffle takes place; repeated rows give equal results; long texts need memory in proportion to a batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexweave import ship
from lexweave.llm.common import release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE = 3 << 19
"""Bytes of text that are encoded at once (one document at least); decoding takes a quarter of it, as it needs a number for each byte."""
CACHE = 24 << 20
"""Bytes of words with their ids, and of piece pairs, that a worker remembers between slices, about."""


ENDING = 4
"""Last characters by which the pieces that may end a prefix are looked up."""


@dataclass
class Pieces:
    """A model: pieces with ids and scores. kind: "bpe" or "unigram"."""

    kind: str
    names: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:  # on the driver; executors get the parsed model
            m.ParseFromString(f.read())
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normalizer are supported")
        kind = {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type]
        usual = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in usual):
            raise ValueError("pieces reach across marked words")
        if m.trainer_spec.model_type == 2 and not all(c in usual for p in usual for c in p):
            raise ValueError("a piece holds a character that is none")
        spelled = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
        byte_ids = [spelled[f"<0x{b:02X}>"] for b in range(256)] if spelled else []
        names = ["" if p.type == 3 else p.piece for p in m.pieces]
        return cls(kind, names, {p: m.pieces[i].score for p, i in usual.items()}, usual, byte_ids, m.trainer_spec.unk_id, m.normalizer_spec.add_dummy_prefix)

    def cuts(self) -> bytes:
        """Control characters at which marked words end: those that no longer piece has."""
        return "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids if len(p) > 1)).encode()


def merged(chars: str, scores: dict[str, float]) -> list[str]:
    """The merge result by definition: the best-scored pair of neighbours that forms a piece is merged first, the leftmost of equal ones."""
    parts: list[str | None] = list(chars)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = [(-scores[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
    heapify(heap)
    while heap:
        _, i, p = heappop(heap)
        j = right[i]
        if parts[i] is None or j < 0 or parts[i] + parts[j] != p:
            continue
        parts[i], parts[j] = p, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (q := parts[a] + parts[b]) in scores:
                heappush(heap, (-scores[q], a, q))
    return [p for p in parts if p is not None]


class Encoder:
    def __init__(self, model: Pieces):
        self.model, self.apart, self.recent, self.older, self.held = model, {}, {}, {}, 0
        self.cuts = np.zeros(256, bool)
        self.cuts[list(model.cuts())] = True
        self.longest = max(map(len, model.ids), default=1)
        ends: dict[str, set[int]] = {}
        for p in model.ids:
            for n in range(2, min(len(p), ENDING) + 1):
                ends.setdefault(p[-n:], set()).update((len(p),) if n == ENDING or n == len(p) else ())
        # lengths of the pieces that end as a prefix does, longest first: by ENDING characters for those that have as many, else by all of them
        self.lengths = {end: tuple(sorted((m for k in range(2, len(end) + 1) for m in ends[end[-k:]]), reverse=True)) for end in ends}
        self.forward = self._merge if model.kind == "bpe" else self._viterbi
        self.lowest = min(model.scores.values(), default=0.0) - 10

    def _stands(self, piece: str) -> bool:
        """Is piece the merge result of its own characters?"""
        key = -1 - self.model.ids[piece]
        if (ok := self.apart.get(key)) is None:
            ok = self.apart[key] = merged(piece, self.model.scores) == [piece]
        return ok

    def _merge(self, word: str, start: int, table: list[str]) -> None:
        """table[i]: last piece of the merge result of word[:i]; entries after start are filled in."""
        find, known, scores, lengths = self.model.ids.get, self.apart.get, self.model.scores, self.lengths
        for i in range(start + 1, len(word) + 1):
            near = ()
            for n in range(min(i, ENDING), 1, -1):
                if (near := lengths.get(word[i - n : i], ())) != ():
                    break
            for n in near:
                if n > i:
                    continue
                t = word[i - n : i]
                b = find(t)
                if b is None:
                    continue
                if n == i or (a := find(u := table[i - n])) is None:
                    if self._stands(t):
                        break
                    continue
                ok = known(key := a << 32 | b)
                if ok is None:
                    ok = self.apart[key] = merged(u + t, scores) == [u, t]
                if ok:
                    break
            else:  # what is left over is the last character by itself
                t = word[i - 1]
            table.append(t)

    def _viterbi(self, word: str, start: int, table: list[tuple[float, str]]) -> None:
        """table[i]: best score of word[:i] and its last piece."""
        scores, longest = self.model.scores, self.longest
        for i in range(start + 1, len(word) + 1):
            best = (table[i - 1][0] + self.lowest, word[i - 1]) if word[i - 1] not in scores else (float("-inf"), "")
            for j in range(max(0, i - longest), i):
                s = scores.get(word[j:i])
                if s is not None and table[j][0] + s > best[0]:
                    best = (table[j][0] + s, word[j:i])
            table.append(best)

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, by one walk through their trie."""
        if 100 * len(self.apart) > CACHE:  # a pair takes some 100 bytes, with its place in the table
            self.apart.clear()
        ids, byte_ids, unknown, viterbi = self.model.ids, self.model.byte_ids, self.model.unknown, self.model.kind != "bpe"
        table: list = [(0.0, "")] if viterbi else [""]
        made: dict[str, tuple[int, ...]] = {}
        last = ""
        for word in sorted(words):
            n, most = 0, min(len(word), len(last))
            while n < most and word[n] == last[n]:
                n += 1
            del table[n + 1 :]
            self.forward(word, n, table)
            last, at, out = word, len(word), []
            while at:
                piece = table[at][1] if viterbi else table[at]
                at -= len(piece)
                if (i := ids.get(piece)) is not None:
                    out.append(i)
                elif byte_ids:
                    out.extend(byte_ids[b] for b in reversed(piece.encode()))
                elif not out or out[-1] != unknown:
                    out.append(unknown)
            out.reverse()
            made[word] = tuple(out)
        return made

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin and end. Null texts have none.

        Words are found in the texts' bytes and told apart by Arrow, so Python only sees distinct ones.
        """
        raw, start = marked(texts, self.model.prefix)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        space, cut = raw == 32, self.cuts[raw]
        begins = cut.copy()
        begins[0] = True
        begins[1:] |= cut[:-1] | (space[1:] & ~space[:-1])
        begins[start[:-1][start[:-1] < len(raw)]] = True
        at = np.flatnonzero(begins)
        kind = (pa.string(), np.int32) if len(raw) < 1 << 31 else (pa.large_string(), np.int64)
        words = pa.Array.from_buffers(kind[0], len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(kind[1])), pa.py_buffer(raw)]).dictionary_encode()
        names, number = words.dictionary.to_pylist(), words.indices.to_numpy()
        recent, older = self.recent, self.older
        lacking = [w for w in names if w not in recent]
        marks = {w: w.replace(" ", MARK) for w in lacking if w not in older}
        made = self.learn(marks.values())
        for w in lacking:
            recent[w] = found = made[marks[w]] if w in marks else older[w]
            self.held += 180 + len(w) + 8 * len(found)
        ids = list(map(recent.__getitem__, names))
        if self.held > CACHE // 2:  # words that come again stay known: those seen since the last change of generation
            self.older, self.recent, self.held = recent, {}, 0
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))
        first, n = (np.cumsum(length) - length)[number], length[number]
        values = gathered(flat, first, n)
        return values, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, start)]


def marked(texts: pa.Array, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, with white space for marks and one more at the start of each that is not empty, and where they begin and end."""
    texts = pc.fill_null(pc.replace_substring(texts, MARK, " "), "")
    if prefix:
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise("", texts, " "))
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    _, places, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begin = int(np.frombuffer(places, wide, 1, texts.offset * np.dtype(wide).itemsize)[0]) if len(texts) else 0
    total = int(size.sum())
    raw = np.frombuffer(data, np.uint8, total, begin) if total else np.zeros(0, np.uint8)
    return raw, np.concatenate(([0], np.cumsum(size)))


def gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs values[first : first + n], one after the other."""
    done = np.cumsum(n)
    total = int(done[-1]) if len(done) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((first - done + n).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return values[at]


class Decoder:
    def __init__(self, model: Pieces):
        self.model, self.byte_of = model, {i: b for b, i in enumerate(model.byte_ids)}
        spelled = [bytes((self.byte_of[i],)) if i in self.byte_of else p.encode() for i, p in enumerate(model.names)]
        spelled = [s.replace(MARK.encode(), b" ") for s in spelled]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def bytes_of(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What lists of ids spell in bytes, one after the other, and where each begins and ends. start: where the lists do."""
        n = self.length[ids]
        return gathered(self.spelled, self.first[ids], n), np.concatenate(([0], np.cumsum(n)))[start]

    def decode(self, ids: np.ndarray, start: np.ndarray) -> list[str]:
        """The text of each list. Bytes that are no UTF-8 become the replacement character."""
        raw, at = self.bytes_of(np.asarray(ids, np.int64), start)
        every = raw.tobytes()
        lead = self.model.prefix
        return [every[a + (lead and every[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())]


def same(texts: pa.Array, ids: np.ndarray, start: np.ndarray, decoder: Decoder) -> np.ndarray:
    """Does each text equal what its ids decode to?"""
    wanted = pc.fill_null(texts, "")
    if decoder.model.prefix:
        wanted = pc.if_else(pc.equal(wanted, ""), wanted, pc.binary_join_element_wise("", wanted, " "))
    out, at = np.zeros(len(texts), bool), 0
    for part in slices(pa.record_batch([wanted], ["text"]), "text", SLICE // 4):
        to = at + part.num_rows
        raw, end = decoder.bytes_of(ids[start[at] : start[to]], start[at : to + 1] - start[at])
        raw = raw.tobytes()
        out[at:to] = [raw[a:b] == t.as_buffer().to_pybytes() for t, a, b in zip(part.column(0), end.tolist(), end[1:].tolist())]
        at = to
    return out


_ENCODERS: dict[str, tuple[Encoder, Decoder]] = {}


def encode(docs: DataFrame, model: Pieces | None = None, text: str = "text", ids: str = "ids", check: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens in place of columns so named; with check also round_trip: do the ids decode to the text?"""
    ship(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model or Pieces.load()), uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in (ids, "n_tokens", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:  # a reused worker keeps what it has learnt, for one model at a time
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value), Decoder(shared.value)
        encoder, decoder = _ENCODERS[key]
        for whole in batches:
            for b in slices(whole, text, SLICE):
                texts = b.column(text)
                values, start = encoder.encode(texts)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(values), mask=pa.array(null))
                more = [pa.array(same(texts, values, start, decoder), pa.bool_(), mask=null)] if check else []
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists, pa.array(np.diff(start), pa.int64(), mask=null), *more], [*keep, ids, "n_tokens", *["round_trip"] * check])
            release()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{ids}` array<int>", "n_tokens bigint", *["round_trip boolean"] * check])
    return docs.select(keep).mapInArrow(run, schema)


def decode(docs: DataFrame, model: Pieces | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text that ids stand for (null for null ids)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or Pieces.load())
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name != text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for b in slices(whole, ids, SLICE // 4):
                lists = b.column(ids)
                null, sizes = lists.is_null().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kinds], pa.array([None if n else t for n, t in zip(null, texts)], pa.string())], [*kinds, text])

    return docs.select(*kinds).mapInArrow(run, ", ".join([*[f"`{c}` {k}" for c, k in kinds.items()], f"`{text}` string"]))
