"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file (a protobuf) is parsed here: pieces with scores and kinds, the trainer's model type
and byte fallback, the normaliser's character map and white-space settings. From these the
tokenizer is rebuilt: normaliser, metaspace marker, unigram scores or BPE merges, byte fallback.
No piece of a model with the usual settings holds the marker after another character, so a text
falls apart before each run of markers without changing its encoding; distinct parts are encoded
once, many as the words of one text, by the library's multithreaded batch call, and a process keeps a bounded number of them. Where a model does hold such a
piece, whole texts are encoded.

Parity: every whole text is also encoded by the ``sentencepiece`` library; ``parity`` says whether
the ids are equal.

Defined results: a null or empty text has no ids and decodes to the empty text; a literal marker
character in a text decodes to a space (``lossless`` is false, as in the model's own library);
repeated rows give repeated results; an empty table gives no rows; other columns pass through
untouched, and new columns that clash with them replace them.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of text that are worked on together, parts that are encoded together, and parts whose
#: ids a process keeps; they bound its memory and change no result.
CHUNK_CHARS, PARTS_AT_ONCE, PARTS_KEPT = 1_000_000, 2_000, 200_000
CACHE = 10_000  # words that the library keeps where whole texts are encoded
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
            pieces.append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown,
        bytes(normal.get(2, b"")), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)),
    )


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first."""
    place = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in place and right in place:
                    found.append((-score, place[left], place[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def _core_model(model: Model, cache: int) -> models.Model:
    """The model that encodes what the steps before it give; the library keeps ``cache`` words."""
    pieces = model.pieces
    if model.kind == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in pieces], model.unknown, model.byte_fallback)
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(pieces)}
        unknown = pieces[model.unknown][0]
        return models.BPE(vocabulary, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=cache)
    raise ValueError(f"model type {model.kind} is neither unigram nor BPE")


def build_tokenizer(model: Model) -> Tokenizer:
    pieces = model.pieces
    made = Tokenizer(_core_model(model, CACHE))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    if _parts_hold(model):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    own = [AddedToken(p, normalized=False) for p, _, k in pieces if k == USER_DEFINED]
    if own:
        made.add_tokens(own)
    made.encode_special_tokens = True
    return made


def _parts_hold(model: Model) -> bool:
    """No piece spans a place before a run of markers, so texts may be cut there."""
    return model.escape and not any(MARK in p.lstrip(MARK) or k == USER_DEFINED for p, _, k in model.pieces)


class Codec:
    """Encodes and decodes batches; one per model file and Python process."""

    def __init__(self, path: str, threads: int = 0) -> None:
        if threads:
            os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as file:
            data = file.read()
        self.model = parse_model(data)
        self.by_parts = _parts_hold(self.model) and not self.model.charsmap and not self.model.squeeze
        self.lead = MARK if self.model.dummy_prefix else ""
        # Parts are normalised where they are cut, come cut, and each is encoded once: no steps, no cache.
        self._core = Tokenizer(_core_model(self.model, 0)) if self.by_parts else self.tokenizer
        self._core.encode_special_tokens = True
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Part -> bytes of its ids (neither is an object the garbage collector visits): those of late, and those before.
        self._made: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        # Parts that decoding does not give back.
        self._lossy: set[str] = set()
        self._bytes = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, k in self.model.pieces
        ]
        self._pieces = pa.array(self._bytes, pa.large_binary())
        self._sizes = np.array([len(x) for x in self._bytes], np.int64)
        self._leads = np.array([p[:1] == MARK for p, _, _ in self.model.pieces], bool)

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """Encodes whole texts; made where it is asked for."""
        return build_tokenizer(self.model)

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._core.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts. Those with one marker, in front, are handed over as the words of one text: a part
        begins where a token begins with a marker, if there are as many such tokens as parts."""
        single = [p for p in parts if p[0] != MARK or p[1:2] == MARK]
        marked = [p for p in parts if p[0] == MARK and p[1:2] != MARK]
        groups = [marked[at : at + PARTS_AT_ONCE] for at in range(0, len(marked), PARTS_AT_ONCE)]
        words = self._core.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False) if groups else []
        for some, e in zip(groups, words, strict=True):
            ids = np.array(e.ids, "<i4")
            begins = (4 * np.flatnonzero(self._leads[ids])).tolist()
            if len(begins) != len(some) or begins[0]:
                single += some
                continue
            data = ids.tobytes()
            for p, start, end in zip(some, begins, [*begins[1:], len(data)], strict=True):
                self._made[p] = data[start:end]
        for p, a in zip(single, self._encode_all(single), strict=True):
            self._made[p] = struct.pack(f"<{len(a)}i", *a)
        self._decode_parts(parts)

    def _decode_parts(self, parts: list[str]) -> None:
        """Notes the parts that decoding does not give back."""
        if not parts:
            return
        made = [self._made[p] for p in parts]
        flat = np.frombuffer(b"".join(made), "<i4")
        data = bytes(self._pieces.take(pa.array(flat)).buffers()[2] or b"")
        ends = np.append(0, np.cumsum(self._sizes[flat]))[np.cumsum([len(m) // 4 for m in made])]
        start = 0
        for p, end in zip(parts, ends.tolist(), strict=True):
            if data[start:end] != p.replace(MARK, " ").encode():
                self._lossy.add(p)
            start = end

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts one after the other, and how many each has: runs of markers and what
        follows each."""
        parted = []
        for t in texts:
            if "  " in t or MARK in t or t[:1] == " " or t[-1:] == " ":
                parted.append(" ".join(PARTS(self.lead + t.replace(" ", MARK))))
            else:
                parted.append(self.lead + t.replace(" ", " " + MARK) if t else None)
        lists = pc.split_pattern(pa.array(parted, pa.large_string()), " ")
        return lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids (little-endian 32-bit) of every text, and whether the other library gives the same."""
        return self.encode_beside(texts)[:2]

    def encode_beside(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """As ``encode``, and whether a text's parts, decoded, are the text. A text's ids are those of its
        parts one after the other, so what its parts decode to is what it decodes to."""
        peer = self.peer.encode(texts, num_threads=1, out_type="numpy")
        if not self.by_parts:
            ids = [np.array(x, "<i4") for x in self._encode_all(texts)]
            return ids, [np.array_equal(a, b) for a, b in zip(ids, peer, strict=True)], [False] * len(texts)
        parts, sizes = self._cut(texts)
        if len(self._made) > PARTS_KEPT:
            self._made, self._before = {}, self._made
            self._lossy.intersection_update(self._before)
        coded = parts.dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        unknown = [p for p in distinct if p not in self._made]
        for p in unknown:
            if p in self._before:
                self._made[p] = self._before[p]
        self._learn([p for p in unknown if p not in self._made])
        # The ids of distinct parts, then those of all parts in the order of the texts.
        made = [self._made[p] for p in distinct]
        own = np.frombuffer(b"".join(made), "<i4")
        lengths = np.array([len(m) // 4 for m in made], np.int64)
        each = lengths[which]
        ends = np.cumsum(each)
        flat = own[np.repeat((np.cumsum(lengths) - lengths)[which] - ends + each, each) + np.arange(each.sum())]
        last = np.cumsum(sizes)
        cuts = np.append(0, ends)[np.append(0, last)].tolist()
        ids = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        lossy = np.array([p in self._lossy for p in distinct], np.int64) if self._lossy else np.zeros(len(distinct), np.int64)
        n_lossy = np.append(0, np.cumsum(lossy[which]))
        # A marker in a text would be decoded to a space.
        whole = [MARK not in t and n == 0 for t, n in zip(texts, (n_lossy[last] - n_lossy[last - sizes]).tolist(), strict=True)]
        return ids, [np.array_equal(x, y) for x, y in zip(ids, peer, strict=True)], whole

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if self.model.dummy_prefix and data[:1] == " " else data

    def decode_beside(self, ids: list[np.ndarray], texts: list[str], whole: list[bool] | None = None) -> list[tuple[int, bool]]:
        """Characters of each decoded text, and whether it is the text; ``whole`` says where its parts
        were found to be."""
        if whole is not None:
            rest = [i for i, same in enumerate(whole) if not same]
            back = iter(self.decode_beside([ids[i] for i in rest], [texts[i] for i in rest]) if rest else [])
            return [(len(t), True) if same else next(back) for t, same in zip(texts, whole, strict=True)]
        flat = np.concatenate(ids)
        data = memoryview(self._pieces.take(pa.array(flat)).buffers()[2] or b"")
        ends = np.append(0, np.cumsum(self._sizes[flat]))[np.cumsum([len(x) for x in ids])]
        out, start = [], 0
        lead = b" " if self.model.dummy_prefix else b""
        for x, t, end in zip(ids, texts, ends.tolist(), strict=True):
            if data[start:end] == (lead + t.encode() if t else b""):
                out.append((len(t), True))
            else:
                back = self.decode(x.tolist())
                out.append((len(back), back == t))
            start = end
        return out


@functools.lru_cache(maxsize=4)
def codec(path: str, threads: int = 0) -> Codec:
    return Codec(path, threads)


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


NEW = {"token_ids": "array<int>", "n_tokens": "int", "ids_sha256": "string", "decoded_chars": "int", "lossless": "boolean", "parity": "boolean"}


def encode_texts(docs: DataFrame, text: str, model_path: str, threads: int = 0) -> DataFrame:
    """``docs`` with token_ids, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_chars, lossless (decoding gives the text back) and parity."""
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in NEW))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        # As many threads as the task has cores, unless a number is asked for.
        made = codec(model_path, threads or (context.cpus() if context else 0))
        for batch in batches:
            column = batch.column(names.index(text))
            for a, b in _chunks(pc.utf8_length(column).fill_null(0).to_pylist()):
                some = [t or "" for t in column.slice(a, b - a).to_pylist()]
                ids, parity, whole = made.encode_beside(some)
                back = made.decode_beside(ids, some, whole)
                sizes = [len(x) for x in ids]
                flat = np.concatenate(ids).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c in batch.columns),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(sizes, pa.int32()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                        pa.array([n for n, _ in back], pa.int32()),
                        pa.array([same for _, same in back], pa.bool_()),
                        pa.array(parity, pa.bool_()),
                    ],
                    [*names, *NEW],
                )

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in NEW.items())).fields])
    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str, model_path: str, into: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id array column; null ids give null."""
    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != into))
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model_path)
        for batch in batches:
            texts = [None if x is None else made.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, into])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))
