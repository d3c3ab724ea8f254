"""Offset-preserving SentencePiece encoding: every piece is projected back to the bytes it came from.

A text is normalised by the longest rule of the model's compiled character map that starts at each place, white space is
squeezed (if the model asks for it) and escaped, and each of these steps leaves a map from places in its output to places
in its input. The normalised text is cut into pieces by the model's byte pair ranks, unknown characters into byte pieces, and
the borders of the pieces go back through the maps, so piece i covers the original bytes ``begins[i]`` to ``ends[i]``.
As in the sentencepiece library, of several byte pieces of one character only the last covers it, and a text of which
nothing is left has no pieces but the end mark.

The normalised text is merged by the library, told to take it as it is. Merges do not cross the start of a word unless a
piece of the vocabulary does, so long texts are merged ``CHUNK`` characters at a time, cut between words.

A null text is an empty one, and has the end mark alone. A null id is an id like others; repeated rows stay; other
columns are not looked at; an empty table gives an empty result. Very long texts are encoded whole: memory is a small
multiple of the longest text plus ``TOKENS`` tokens. Bytes that are not UTF-8 become U+FFFD one by one.
Models other than byte pair models, and those with user-defined or unused pieces or white space as a suffix, are refused.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import bytes_of, cell

#: Characters of a normalised text that are merged at once.
CHUNK = 1 << 16
#: Tokens that a task holds before it passes them on.
TOKENS = 1 << 20

_SPACE = "▁"


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Places:
    """Maps places in a step's output to places in its input: runs that are copied, and runs that stand for one place."""

    def __init__(self, out: np.ndarray, into: np.ndarray, copied: np.ndarray):
        self.out, self.into, self.copied = out, into, copied

    def back(self, places: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.out, places, side="right") - 1
        return self.into[run] + np.where(self.copied[run], places - self.out[run], 0)


class CharacterMap:
    """The rules of a compiled character map: a double-array trie over UTF-8 keys, and the replacements behind it."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, str] = {}
        if blob:
            size = int.from_bytes(blob[:4], "little")
            values = blob[4 + size :]
            for key, at in _keys(np.frombuffer(blob, "<u4", size // 4, 4)):
                self.rules[key.decode()] = values[at : values.index(b"\0", at)].decode()
        self.longest = max(map(len, self.rules), default=0)
        alone = {k for k in self.rules if len(k) == 1}
        more = [k for k in self.rules if len(k) > 1 and k[0] not in alone]

        def kinds(chars: set[str]) -> str:
            return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"

        ways = ([kinds(alone)] if alone else []) + ([kinds({k[0] for k in more}) + "(?=" + kinds({k[1] for k in more}) + ")"] if more else [])
        self.start = re.compile("|".join(ways)) if ways else None

    def apply(self, text: str) -> tuple[str, Places | None]:
        """The text after the longest rule at each place, and where its bytes come from (None: from the same place)."""
        hit = self.start.search(text) if self.start else None
        if hit is None:
            return text, None
        parts, out, into, copied = [], [0], [0], [True]
        done = at = 0  # characters copied, and looked at

        def place(size: int, origin: int, same: bool) -> None:
            out.append(out[-1] + size)
            into.append(origin)
            copied.append(same)

        origin = 0
        while hit is not None:
            at = hit.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                new = self.rules.get(text[at : at + n])
                if new is not None:
                    plain = text[done:at]
                    size = len(plain.encode())
                    origin += size
                    parts += (plain, new)
                    place(size, origin, False)
                    origin += len(text[at : at + n].encode())
                    place(len(new.encode()), origin, True)
                    done = at = at + n
                    break
            else:
                at += 1
            hit = self.start.search(text, at)
        parts.append(text[done:])
        return "".join(parts), Places(np.array(out), np.array(into), np.array(copied))


def _keys(units: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(key, value) of a double-array trie, level by level; a unit holds its label, an offset and a leaf flag."""
    units = units.astype(np.int64)
    offset = (units >> 10) << ((units & 512) >> 6)
    nodes, keys = np.array([offset[0]]), [b""]
    labels = np.arange(1, 256)
    while len(nodes):
        places = nodes[:, None] ^ labels
        inside = places < len(units)
        unit = units[np.where(inside, places, 0)]
        owner, label = np.nonzero(inside & ((unit & 0x800000FF) == labels))
        at = places[owner, label]
        keys = [keys[o] + bytes([c + 1]) for o, c in zip(owner.tolist(), label.tolist())]
        nodes = at ^ offset[at]
        leaf = (units[at] >> 8) & 1 == 1
        ends = np.where(leaf, units[np.where(leaf, nodes, 0)] & 0x7FFFFFFF, -1)
        for key, value in zip(keys, ends.tolist()):
            if value >= 0:
                yield key, value


class Encoder:
    """A byte pair model read from its file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError("only byte pair models without user-defined or unused pieces, with white space in front, are supported")
        self.model = model
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.squeeze, self.prefix, self.escape = norm.remove_extra_whitespaces, norm.add_dummy_prefix, norm.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        byte = {f"<0x{b:02X}>": b for b in range(256)}
        self.byte_of = np.array([byte[p.piece] if p.type == 6 else -1 for p in proto.pieces], np.int16)
        self.sizes = np.array([len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.fallback = trainer.byte_fallback
        self.end = next((i for i, p in enumerate(proto.pieces) if p.type == 3 and p.piece == (trainer.eos_piece or "</s>")), None)
        # without a piece that goes on after a word's start, merges stay inside words
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        self.start_of_word = re.compile(f"[^{_SPACE}](?={_SPACE})")
        norm.precompiled_charsmap = b""
        norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
        self.plain = proto.SerializeToString()
        self._opened = None

    def normalise(self, raw: bytes) -> tuple[str, list[Places]]:
        """The normalised text and the maps from its bytes back to the raw ones, last step first."""
        steps: list[Places] = []
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            codecs.register_error("one_by_one", _one_by_one)
            text = raw.decode(errors="one_by_one")
            steps.append(_replaced(raw, text))
        text, step = self.map.apply(text)
        if step is not None:
            steps.append(step)
        data = np.frombuffer(text.encode(), np.uint8)
        if self.squeeze and len(data):
            space = data == 32
            keep = ~(space & np.concatenate(([True], space[:-1])))
            if space[-1] and keep.any():
                keep[np.flatnonzero(~space)[-1] + 1 :] = False
            if not keep.all():
                starts = np.flatnonzero(keep & ~np.concatenate(([False], keep[:-1])))
                steps.append(Places(np.cumsum(keep)[starts] - 1, starts, np.ones(len(starts), bool)) if len(starts) else _NOTHING)
                data = data[keep]
                text = data.tobytes().decode()
        if not len(data):
            return "", steps
        lead = self.prefix * (3 if self.escape else 1)
        spaces = np.flatnonzero(data == 32) if self.escape else np.zeros(0, np.int64)
        if lead or len(spaces):
            # each white space: three bytes for its place, then what follows is copied
            first = spaces + 2 * np.arange(len(spaces)) + lead
            out = np.concatenate(([0, lead], np.column_stack((first, first + 3)).ravel()))
            into = np.concatenate(([0, 0], np.column_stack((spaces, spaces + 1)).ravel()))
            copied = np.concatenate(([False, True], np.tile([False, True], len(spaces))))
            steps.append(Places(out, into, copied))
        mark = _SPACE if self.escape else " "
        text = (mark if self.prefix else "") + (text.replace(" ", _SPACE) if self.escape else text)
        if self.squeeze:
            text = text.rstrip(mark)
        return text, steps[::-1]

    @property
    def segmenter(self):
        """The library's processor over the same pieces, which takes a text as normalised already; opened once a task."""
        if self._opened is None:
            import sentencepiece

            self._opened = sentencepiece.SentencePieceProcessor(model_proto=self.plain)
        return self._opened

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_opened": None}

    def _chunks(self, text: str) -> Iterator[str]:
        """The text in parts that merges do not cross: cut before a word, at least ``CHUNK`` characters after the last cut."""
        at = 0
        while self.cuts and len(text) - at > CHUNK:
            cut = self.start_of_word.search(text, at + CHUNK)
            if cut is None:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:]

    def _segment(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bytes covered) of a normalised text."""
        if not self.fallback:  # neighbouring unknown pieces are one, of a length that its id does not tell
            pieces = self.segmenter.encode(text, return_type="proto").pieces
            return np.array([p.id for p in pieces], np.int32), np.array([p.end - p.begin for p in pieces], np.int64)
        ids = np.concatenate([np.array(self.segmenter.encode(part), np.int32) for part in self._chunks(text)])
        sizes = self.sizes[ids]
        value = self.byte_of[ids]
        if (value >= 0).any():
            # the byte pieces of a character: a leading one and those that continue it; the last covers them all
            more = (value >= 0x80) & (value < 0xC0)
            last = (value >= 0) & ~np.append(more[1:], False)
            lead = np.maximum.accumulate(np.where(more, 0, np.arange(len(ids))))
            sizes = np.where(value >= 0, np.where(last, np.arange(len(ids)) - lead + 1, 0), sizes)
        return ids, sizes

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends) of one text without the end mark."""
        text, steps = self.normalise(raw)
        ids, sizes = self._segment(text) if text else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        borders = np.concatenate(([0], np.cumsum(sizes)))
        for step in steps:
            borders = step.back(borders)
        return ids, borders[:-1].astype(np.int32), borders[1:].astype(np.int32)


_NOTHING = Places(np.array([0]), np.array([0]), np.array([False]))


def _replaced(raw: bytes, text: str) -> Places:
    """Where a text comes from whose bad bytes became U+FFFD."""
    out, into, copied, at, origin = [0], [0], [True], 0, 0
    mark = "�".encode()
    for part in re.split("(�)", text):
        data = part.encode()
        if data == mark and not raw.startswith(mark, origin):
            out += [at, at + 3]
            into += [origin, origin + 1]
            copied += [False, True]
            at, origin = at + 3, origin + 1
        else:
            at, origin = at + len(data), origin + len(data)
    return Places(np.array(out), np.array(into), np.array(copied))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per document: doc_id, ids, begins, ends (bytes of the text that each piece covers) and decoded.

    ``decoded`` is what the library's ``decode`` makes of the ids. The model is read once on the driver (half a
    megabyte for 32,000 pieces) and travels with the function; an end mark covers the empty end of the text.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    encoder = Encoder(model)
    mark = [] if not end else [encoder.end]
    if mark == [None]:
        raise ValueError("the model has no end mark")
    slim = docs.select(cell(id_col).alias("doc_id"), cell(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "begins", "ends", "decoded"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=encoder.model)

        def out(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[k] for r in rows]))) for k in range(3)]
            return pa.RecordBatch.from_arrays([keys, *lists, pa.array([r[3] for r in rows], pa.string())], names=names)

        for batch in batches:
            keys, rows, first, held = batch.column(0), [], 0, 0
            for i, raw in enumerate(bytes_of(batch.column(1))):
                raw = raw or b""
                ids, begins, ends = encoder.encode(raw)
                if mark:
                    last = np.array([len(raw)], np.int32)
                    ids, begins, ends = np.append(ids, np.int32(mark[0])), np.append(begins, last), np.append(ends, last)
                rows.append((ids, begins, ends, library.decode(ids.tolist())))
                held += len(ids)
                if held >= TOKENS:
                    yield out(keys.slice(first, len(rows)), rows)
                    rows, first, held = [], i + 1, 0
            if rows:
                yield out(keys.slice(first, len(rows)), rows)

    lists = "ids array<int>, begins array<int>, ends array<int>"
    return slim.mapInArrow(pieces, f"doc_id {kind}, {lists}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the bytes that the pieces cover."""
    covered = F.aggregate(F.arrays_zip("begins", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["begins"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.alias("n_bytes_covered"),
    )
